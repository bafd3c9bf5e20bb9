"""Directly addressable codes: ids cut into chunks of 8 bits, one level a chunk.

Level k holds the k-th chunk of every id that has one, and a bitmap that tells
which of them continue; a rank directory (ones before each block of 512 bits)
leads from an entry to its place on the next level.  Any id is read from one
byte and one rank a level; nothing around it is decoded.

Within a segment ids are first replaced by their rank of frequency (the map is
in the segment's header), so that frequent ids need one level only.

Layout, little-endian: magic ``DAC1``; u32 documents, u64 ids, u32 distinct ids,
u32 levels; i64 doc ids, u8 null flags; u32 ids per document; u32 distinct ids
by rank; per level: u64 entries, chunks, bitmap bytes, u64 directory.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC, BLOCK = b"DAC1", 512
_HEAD = struct.Struct("<4sIQII")
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.uint8)


def encode(docs: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment of whole documents; ``ids`` has the ids of all of them in order."""
    ids = np.asarray(ids, dtype=np.uint32)
    count = np.bincount(ids) if len(ids) else np.zeros(0, dtype=np.int64)
    order = np.argsort(-count, kind="stable")[: int((count > 0).sum())].astype(np.uint32)
    rank = np.zeros(len(count), dtype=np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    rest, levels = rank[ids] if len(ids) else ids, []
    while True:
        more = rest > 255
        levels.append(((rest & 255).astype(np.uint8), more))
        if not more.any():
            break
        rest = rest[more] >> 8
    out = [
        _HEAD.pack(MAGIC, len(docs), len(ids), len(order), len(levels)),
        np.array([d or 0 for d in docs], dtype="<i8").tobytes(), np.array([d is None for d in docs], dtype=np.uint8).tobytes(),
        np.asarray(lengths, dtype="<u4").tobytes(), order.astype("<u4").tobytes(),
    ]
    for chunks, more in levels:
        bits = np.packbits(np.pad(more, (0, -len(more) % BLOCK)), bitorder="little")
        ones = _ONES[bits].reshape(-1, BLOCK // 8).sum(1, dtype=np.uint64)
        out += [struct.pack("<Q", len(chunks)), chunks.tobytes(), bits.tobytes(), (np.cumsum(ones) - ones).astype("<u8").tobytes()]
    return b"".join(out)


class Segment:
    """Random access to an encoded segment."""

    def __init__(self, data: bytes):
        magic, n_docs, self.n_ids, distinct, levels = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a DAC segment")
        self._data, self._at = data, _HEAD.size
        docs, null = self._take("<i8", n_docs), self._take("u1", n_docs)
        self.docs = [None if n else int(d) for d, n in zip(docs, null, strict=True)]
        self.lengths = self._take("<u4", n_docs)
        self.ids = self._take("<u4", distinct)
        self.levels = []
        for _ in range(levels):
            n = int(self._take("<u8", 1)[0])
            blocks = -(-n // BLOCK)
            self.levels.append((self._take("u1", n), self._take("u1", blocks * BLOCK // 8), self._take("<u8", blocks)))

    def _take(self, kind: str, n: int) -> np.ndarray:
        a = np.frombuffer(self._data, dtype=kind, count=n, offset=self._at)
        self._at += a.nbytes
        return a

    def _rank(self, level: int, i: int) -> int:
        """Ones before entry i."""
        _, bits, before = self.levels[level]
        if i // BLOCK >= len(before):  # the end of the level
            return len(self.levels[level + 1][0]) if level + 1 < len(self.levels) else 0
        first, byte = i // BLOCK * (BLOCK // 8), i // 8
        ones = int(before[i // BLOCK]) + int(_ONES[bits[first:byte]].sum())
        return ones + int(_ONES[bits[byte] & ((1 << i % 8) - 1)])

    def __getitem__(self, i: int) -> int:
        code = shift = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            code |= int(chunks[i]) << shift
            if not bits[i // 8] >> i % 8 & 1:
                break
            i, shift = self._rank(level, i), shift + 8
        return int(self.ids[code])

    def slice(self, a: int, b: int) -> np.ndarray:
        """The ids a to b, as unsigned 32-bit integers; reads those entries alone."""
        code = at = None
        for level, (chunks, bits, _) in enumerate(self.levels):
            if a == b:
                break
            part = chunks[a:b].astype(np.uint32)
            if code is None:
                code, at = part, np.arange(b - a)
            else:
                code[at] |= part << np.uint32(8 * level)
            more = np.unpackbits(bits[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            at = at[more]
            a = self._rank(level, a)
            b = a + len(at)
        return self.ids[code] if code is not None else np.zeros(0, dtype=np.uint32)
