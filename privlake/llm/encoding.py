"""Whole-text token ids through the ``tokenizers`` library, fast.

Both public vocabularies first cut a text at fixed places (letters, numbers,
signs, white space) and merge within the pieces only, so equal pieces have equal
ids wherever they stand.  A bounded cache per Python worker holds the ids of the
pieces met first; the library encodes the rest.

Ways to cut, each at places where the vocabulary's own rule cuts too:
- prose of Latin letters, commas and full stops: by splitting;
- texts of plain Latin letters, digits and signs: the rule itself, in ``re``;
- other texts: before each run of ASCII white space;
- texts with other white space than ASCII, or with the string of one of the
  vocabulary's added tokens (<|endoftext|>): not at all, so the ids are the
  library's own, that token's id included.
"""

from __future__ import annotations

import os
import re

from privlake.llm.common import kept

CACHE_ENTRIES = 600_000
_BY_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
_ODD_SPACE = [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_ODD = re.compile(f"[{''.join(map(chr, _ODD_SPACE))}]")
#: Not plain: controls, the apostrophe (English endings are cut specially), superscripts and fractions, and all
#: beyond Latin letters (marks could combine over a cut).
_PLAIN = [(0x09, 0x0D), (0x20, 0x26), (0x28, 0x7E), (0xA1, 0xB1), (0xB4, 0xB8), (0xBA, 0xBB), (0xBF, 0x12F), (0x131, 0x24F)]
_NOT_PLAIN = re.compile("[^" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in _PLAIN) + "]")
#: White space before a word belongs to it, or is dropped.
_SPACED = re.compile(r" ?[^\W\d_]+| ?[0-9]+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
_DROPPED = re.compile(r"[^\W\d_]+|[0-9]+|(?:[^\w\s]|_)+")


#: Plain prose: letters, single spaces, line ends, commas and full stops, where splitting finds the same pieces.
_NOT_PROSE = re.compile("[^A-Za-z ,.\\n\xC0-\xD6\xD8-\xF6\xF8-\u012F\u0131-\u024F]")
_TOUCHING = ("..", ".,", ",.", ",,", " .", " ,", "  ", "\n\n", "\n ", " \n", "\n.", "\n,")


class _Cache(dict):
    def __init__(self, tokenizer, entries: int):
        super().__init__()
        self.tokenizer, self.entries = tokenizer, entries

    def encode(self, text: str) -> bytes:
        import numpy as np

        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(self) < self.entries:
            self[piece] = ids
        return ids


class Encoder:
    """``encode(text)``: the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self._added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self._cache = _Cache(tokenizer, entries)
        one = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        # what the vocabulary does with case and white space, asked of itself
        self._lower, self._drops = one("Q") == one("q"), one(" \n ") == []
        self._cut = _DROPPED if self._drops else _SPACED

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(x in text for x in self._added):
            return self._cache.encode(text)
        if not _NOT_PROSE.search(text) and not any(x in text for x in _TOUCHING):
            pieces = self._prose(text.lower() if self._lower else text)
        elif not _NOT_PLAIN.search(text):
            pieces = self._cut.findall(text.lower() if self._lower else text)
        elif not _ODD.search(text):
            pieces = _BY_SPACE.findall(text)
        else:
            return self._cache.encode(text)
        return b"".join(map(self._cache.__getitem__, pieces))

    def _prose(self, text: str) -> list[str]:
        if self._drops:
            return text.replace(",", " , ").replace(".", " . ").split()
        return text.replace(",", "\0,").replace(".", "\0.").replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")


_ENCODERS: dict[str, Encoder] = kept({})


def encoder(path: str) -> Encoder:
    """This worker's encoder of the vocabulary file at ``path``."""
    if path not in _ENCODERS:
        _ENCODERS.clear()  # a worker serves one vocabulary at a time; the cache is its largest part
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
