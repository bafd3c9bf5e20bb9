"""PII: base patterns, and a semi-Markov conditional random field for what they miss.

The field scores whole segments of tokens: a segment's features describe the span
as a whole (digits, groups, separators, checks such as Luhn, the word before it)
and a weight matrix turns them into a score for each kind.  Segments are at most
``MAX_TOKENS`` tokens, so decoding is a dynamic program of T x MAX_TOKENS x kinds
steps that picks boundaries and kinds together.  It is trained here, by gradient
ascent on the conditional likelihood, on sentences that a seeded generator writes
with their spans (phone numbers without a plus, addresses with " at ", dotted card
numbers, and look-alikes that aren't personal: dates, prices, versions, ISBNs).

Only stretches of a text that hold a trigger (a run of digits and separators, or
an at-sign in any spelling) are decoded; the rest can't hold a span.  Where base
spans touch a trigger, the triggers in its parts beside them count.  Base spans
always stay, and their tokens are no part of the field's spans.

Edge cases: null or empty text has no spans; whole texts are read, in linear
time; repeated rows are scanned each; null ids are kept; an empty table gives an
empty result.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from privlake.llm.common import table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
MAX_TOKENS = 12

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is tried from its first digit: from a later one the rest is the same
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: a match of the at-sign at p starts where the run of local characters before p does."""
    last, p = 0, text.find("@")
    while p >= 0:
        s = p
        while s > last and _LOCAL.match(text[s - 1]):
            s -= 1
        m = _DOMAIN.match(text, p + 1) if s < p else None
        if m:
            yield s, m.end()
            last = m.end()
            p = text.find("@", last)
        else:
            last = p + 1 if s == p else last
            p = text.find("@", p + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind as listed and start."""
    found = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(_at_most_255(x) for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 13 <= m.end() - m.start():
                digits = "".join(_DIGIT.findall(m[0]))
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found.append((2, m.start(), m.end()))
        if "+" in text:
            found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return found


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


# --- the field ---

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|_")
_NUMBERS = re.compile(r"[0-9() ./-]{7,}+")
_AT = re.compile(r"@|\(at\)|\[at\]| at(?= )")
_AFTER_AT = re.compile(r" ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]++)+")
#: A longer segment is no span of any kind.
MAX_CHARS = 320
_REACH = 30
_CUES = {
    "phone": "p", "tel": "p", "telephone": "p", "call": "p", "mobile": "p", "fax": "p", "cell": "p", "number": "p", "ring": "p", "dial": "p", "tél": "p", "téléphone": "p", "teléfono": "p", "telefon": "p",
    "mail": "m", "email": "m", "contact": "m", "write": "m", "card": "c", "visa": "c", "mastercard": "c", "carte": "c", "karte": "c", "tarjeta": "c",
    "ip": "i", "host": "i", "server": "i", "address": "i", "isbn": "x", "version": "x", "page": "x", "pages": "x", "order": "x", "invoice": "x",
    "no": "x", "on": "x", "from": "x", "price": "x", "figure": "x", "ref": "x",
}


#: A single token that is too long for any span.
LONG = ["dig=0", "at=False,False,False", "long"]


def _features(text: str, tokens: list[tuple[int, int]], i: int, j: int, phones: tuple[int, ...] = ()) -> list[str]:
    """Features of the segment of tokens i to j (exclusive) as a whole; a phone's end (``phones``) with no letter since is a cue."""
    s, e = tokens[i][0], tokens[j - 1][1]
    span = text[s:e]
    digits = "".join(_DIGIT.findall(span))
    n, lower = len(digits), span.lower()
    groups = re.findall(r"[0-9]+", span)
    seps = "".join(sorted(set(re.sub(r"[\w]", "", span))))
    before = text[max(0, s - 24) : s].lower()
    cue = next((_CUES[w] for w in reversed(re.findall(r"[^\W\d_]+", before)[-2:]) if w in _CUES), "-")
    if any(0 <= s - x <= 24 and not any(c.isalpha() for c in text[x:s]) for x in phones):
        cue = "p"
    f = [f"len={min(j - i, 9)}", f"dig={n if n < 20 else 20}", f"groups={min(len(groups), 6)}", f"seps={seps}", f"cue={cue}", f"cue={cue}&dig={n // 3}"]
    f.append("ends=" + ("d" if span[0].isdigit() else "(" if span[0] in "(+" else "a" if span[0].isalpha() else "o") + ("d" if span[-1].isdigit() else "a" if span[-1].isalpha() else "o"))
    if n and any(c.isalpha() for c in span):
        f.append("mixed")
    if 13 <= n <= 19:
        f += [f"luhn={luhn(digits)}", "equal=" + str(len({len(g) for g in groups[:-1]}) <= 1)]
    if len(groups) == 4 and seps == ".":
        f.append("quad=" + str(all(_at_most_255(g) for g in groups)))
    if n:
        f.append("shape=" + "-".join(str(min(len(g), 5)) for g in groups[:5]))
    at = re.search(r"@|\bat\b", lower)
    dot = at and re.search(r"\.(?=\S)|\bdot\b", lower[at.end() :])
    f.append(f"at={bool(at)},{bool(dot)},{bool(at and 0 < at.start() < len(span) - 3)}")
    if at and re.search(r"(\.|\bdot\b)[\])]?\s*[a-z]{2,4}$", lower):
        f.append("tld")
    if at:
        local, joined_left = lower[: at.start()].strip(" (["), s > 0 and text[s - 1] in "._-+%"
        f.append(f"local={' ' in local},{joined_left},{local[:1].isalnum()}")
        f.append(f"domain={len(re.findall('[^.]+', re.sub(r'[^a-z0-9.-]+dot[^a-z0-9.-]+', '.', lower[at.end() :].strip(' )]'))))},{lower.rstrip()[-1:].isalnum()}")
    touch = (s > 0 and not text[s - 1].isspace() and text[s - 1] not in "(:\"'") or (e < len(text) and (text[e].isalnum() or text[e] in "-/@" or text[e] == "." and text[e + 1 : e + 2].isalnum()))
    f.append(f"cut={touch}")
    if j < len(tokens) and n and text[e : tokens[j][1]].strip(" .-)").isdigit() and tokens[j][0] - e < 2:
        f.append("more digits")
    if i and n and text[tokens[i - 1][0] : s].strip(" .-(").isdigit() and s - tokens[i - 1][1] < 2:
        f.append("digits before")
    return f


def _possible(f: list[str]) -> list[bool]:
    """By label, whether a segment with these features can have it at all."""
    has = set(f)
    digits = next(int(x[4:]) for x in f if x.startswith("dig="))
    plain = "mixed" not in has
    return [True, "at=True,True,True" in has, "quad=True" in has and plain, "luhn=True" in has and plain, 8 <= digits <= 15 and plain]


def _plausible(span: str) -> bool:
    """Whether a segment can be a span at all, before its features are worked out: what ``_possible`` asks at least."""
    return 8 <= len(_DIGIT.findall(span)) <= 19 or "@" in span or "at" in span.lower() or span.count(".") == 3


class SemiMarkov:
    """Weights by feature (rows of one score a label) and by pair of neighbouring labels."""

    def __init__(self, weights: dict[str, list[float]] | None = None, pairs=None):
        import numpy as np

        self.weights = {k: np.asarray(v) for k, v in (weights or {}).items()}
        self.pairs = np.zeros((len(LABELS), len(LABELS))) if pairs is None else np.asarray(pairs)

    def _segments(self, text: str, tokens, i: int, phones: tuple[int, ...] = ()):
        """(scores by label, features) of the segments of 1, 2, ... tokens from i; longer ones than a token can't be 'none'."""
        import numpy as np

        zero, none = np.zeros(len(LABELS)), np.full(len(LABELS), -np.inf)
        for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
            long = tokens[j - 1][1] - tokens[i][0] > MAX_CHARS
            if j > i + 1 and (long or tokens[j - 1][0] - tokens[j - 2][1] > 1):
                break  # a span has no wide gap
            if j > i + 1 and not _plausible(text[tokens[i][0] : tokens[j - 1][1]]):
                yield none, []
                continue
            f = LONG if long else _features(text, tokens, i, j, phones)
            v = sum((self.weights[x] for x in f if x in self.weights), zero)
            allowed = _possible(f)
            allowed[0] = j == i + 1
            yield np.where(allowed, v, -np.inf), f

    def decode(self, text: str, tokens, phones: tuple[int, ...] = ()) -> list[tuple[int, int, int]]:
        """(label, i, j) of the best segmentation, without 'none'."""
        import numpy as np

        n = len(tokens)
        best = np.full((n + 1, len(LABELS)), -np.inf)
        came, was = np.zeros(best.shape, dtype=np.int32), np.zeros(best.shape, dtype=np.int8)
        best[0, 0] = 0.0
        for i in range(n):
            come = best[i][:, None] + self.pairs
            top, arg = come.max(0), come.argmax(0)
            for k, (v, _) in enumerate(self._segments(text, tokens, i, phones)):
                total = top + v
                for y in np.flatnonzero(total > best[i + k + 1]):
                    best[i + k + 1, y] = total[y]
                    came[i + k + 1, y], was[i + k + 1, y] = i, arg[y]
        out, at, y = [], n, int(best[n].argmax())
        while at > 0:
            i = int(came[at, y])
            if y:
                out.append((y, i, at))
            at, y = i, int(was[at, y])
        return out[::-1]

    def step(self, text: str, tokens, gold: set[tuple[int, int, int]], rate: float) -> None:
        """One step up the gradient of the log likelihood of ``gold``: observed less expected features."""
        import numpy as np

        n, k = len(tokens), len(LABELS)
        rows = [list(self._segments(text, tokens, i)) for i in range(n)]
        scores, used = ([[x[c] for x in row] for row in rows] for c in (0, 1))
        alpha, beta = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
        alpha[0, 0] = 0.0
        beta[n] = 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            into = np.full((n, k), -np.inf)
            for i in range(n):
                into[i] = np.logaddexp.reduce(alpha[i][:, None] + self.pairs, axis=0)
                for d, v in enumerate(scores[i]):
                    alpha[i + d + 1] = np.logaddexp(alpha[i + d + 1], into[i] + v)
            out = np.full((n, k), -np.inf)
            for i in range(n - 1, -1, -1):
                for d, v in enumerate(scores[i]):
                    out[i] = np.logaddexp(out[i], v + beta[i + d + 1])
                beta[i] = np.logaddexp.reduce(self.pairs + out[i][None, :], axis=1)
            total = np.logaddexp.reduce(alpha[n])
            change = np.zeros((k, k))
            for i in range(n):
                change -= np.nan_to_num(np.exp(alpha[i][:, None] + self.pairs + out[i][None, :] - total))
                for d, v in enumerate(scores[i]):
                    g = -np.exp(into[i] + v + beta[i + d + 1] - total)
                    g = np.nan_to_num(g)
                    for y, a, b in gold:
                        if (a, b) == (i, i + d + 1):
                            g[y] += 1.0
                    if np.abs(g).max() > 1e-4:
                        for x in used[i][d]:
                            self.weights[x] = self.weights.get(x, 0.0) + rate * g
        was = 0
        for y, _, _ in sorted(gold, key=lambda s: s[1]):
            change[was, y] += 1
            was = y
        self.pairs = self.pairs + rate * change


def generated(n: int, seed: int = 7) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Sentences with their spans (label, start, end)."""
    import random

    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(("an", "er", "tion", "the", "ou", "la", "ken", "mi", "so", "re")) for _ in range(r.randint(1, 3)))

    def card() -> str:
        d = r.choice("3456") + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return r.choice((".", "-", " ", "")).join(d[k : k + 4] for k in range(0, 16, 4))

    def phone() -> str:
        return r.choice((f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"{num(3)}.{num(3)}.{num(4)}", f"0{num(3)} {num(7)}", f"+{num(2)} {num(3)} {num(6)}"))

    def mail() -> str:
        local = word() + r.choice(("", "." + word(), "." + word(), "_" + word()))
        return r.choice((" at ", " [at] ", "@", " @ ", "(at)")).join((local, word())) + r.choice((" dot ", ".", "[dot]", " [dot] ")) + r.choice(("com", "org", "net", "fr", "de"))

    ip = lambda: ".".join(str(r.randint(1, 255)) for _ in range(4))
    plain = (
        lambda: f"on {r.randint(1, 28):02}/{r.randint(1, 12):02}/{r.randint(1950, 2030)}", lambda: f"price {num(2)}.{num(2)} {num(3)}",
        lambda: f"version {num(1)}.{num(1)}.{num(2)}", lambda: f"isbn 978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", lambda: f"order {num(8)}",
        lambda: f"from {r.randint(1900, 1999)}-{r.randint(2000, 2030)}", lambda: f"pages {num(3)}-{num(3)} {num(2)}", lambda: f"invoice {num(4)}-{num(6)}",
        lambda: f"{num(3)} {num(3)} {num(3)}", lambda: f"2024-{num(2)}-{num(2)} 10:{num(2)}:00", lambda: f"{word()} at {word()}", lambda: f"ref {num(12)}", lambda: f"{num(16)}",
        lambda: 'token = "' + "".join(r.choice("0123456789abcdef") for _ in range(r.choice((12, 24, 40)))) + '"', lambda: f"key {word()}{num(9)}{word()}",
    )
    cues = ("", "mail", "contact", "write to"), ("", "ip", "host", "server"), ("", "card", "visa", "pay with card"), ("call", "tel", "phone", "tel:", "mobile", "fax", "ring", "my number is")
    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(r.randint(0, 2))), []
        for _ in range(r.randint(1, 2)):
            if r.random() < 0.5:
                text += " " + r.choice(plain)() + r.choice(("", ".", ","))
            else:
                k = r.randrange(4)
                text += " " + r.choice(cues[k]) + " "
                value = (mail, ip, card, phone)[k]()
                spans.append((k + 1, len(text), len(text) + len(value)))
                text += value + r.choice(("", ".", ","))
            text += " " + " ".join(word() for _ in range(r.randint(0, 2)))
        out.append((text, spans))
    return out


RATE = 0.1


@lru_cache(maxsize=1)
def trained(sentences: int = 220, rounds: int = 5) -> SemiMarkov:
    model = SemiMarkov()
    data = []
    for text, spans in generated(sentences):
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        starts, ends = {s: i for i, (s, _) in enumerate(tokens)}, {e: i + 1 for i, (_, e) in enumerate(tokens)}
        gold = {(y, starts[s], ends[e]) for y, s, e in spans}
        inside = {t for _, a, b in gold for t in range(a, b)}
        data.append((text, tokens, gold | {(0, t, t + 1) for t in range(len(tokens)) if t not in inside}))
    total, pairs, seen = {}, 0.0, 0
    for k in range(rounds):
        for i, row in enumerate(data):
            model.step(*row, RATE / (1 + 0.3 * k))
            if k >= rounds // 2 and i % 20 == 19:  # the mean of the weights along the way
                seen += 1
                pairs = pairs + model.pairs
                for x, v in model.weights.items():
                    total[x] = total.get(x, 0.0) + v
    return SemiMarkov({x: v / seen for x, v in total.items()}, pairs / seen) if seen else model


def _triggers(text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """Stretches of ``text`` between two places that may hold a span, in order and apart: runs of digits, brackets and
    separators from their first digit or bracket to their last digit, and what surrounds an at-sign in any spelling.

    Every run is walked once: no part of a run is tried again from a later start.
    """
    end = len(text) if end is None else end
    found = []
    for m in _NUMBERS.finditer(text, start, end):
        left = m.end() - len(m[0].lstrip(" )./-"))
        right = m.start() + len(m[0].rstrip(" ()./-"))
        if right - left >= 7:
            found.append((left, right))
    last = start
    for m in _AT.finditer(text, start, end):
        after = _AFTER_AT.match(text, m.end() + (m[0] == " at"), end)
        if after is None or m.start() < last:
            continue
        s = m.start()
        s -= s > last and text[s - 1] == " "
        stop = s
        while s > last and _LOCAL.match(text[s - 1]):
            s -= 1
        if s < stop:
            found.append((s, after.end()))
            last = after.end()
    found.sort()
    out: list[tuple[int, int]] = []
    for s, e in found:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _free_triggers(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Triggers beside the sorted spans ``taken``, which cut those that they touch."""
    k = 0
    for at, end in _triggers(text):
        while k < len(taken) and taken[k][1] <= at:
            k += 1
        i = k
        while i < len(taken) and taken[i][0] < end:
            a, b = taken[i]
            if at < a:
                yield from _triggers(text, at, a)
            at = max(at, b)
            i += 1
        if i == k:
            yield at, end
        elif at < end:
            yield from _triggers(text, at, end)


def added_spans(text: str, base: list[tuple[int, int, int]], model: SemiMarkov) -> list[tuple[int, int, int]]:
    """The field's spans (kind, start, end) in the stretches around triggers, none over a base span."""
    from bisect import bisect_left, bisect_right
    from itertools import accumulate

    taken = sorted((s, e) for _, s, e in base)
    stretches: list[list[int]] = []
    for s, e in _free_triggers(text, taken):
        if stretches and s - _REACH <= stretches[-1][1] and e - stretches[-1][0] < 400:
            stretches[-1][1] = e + _REACH
        else:
            stretches.append([max(0, s - _REACH), e + _REACH])
    if not stretches:
        return []
    starts, ends = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    phone_ends = sorted(z for k, _, z in base if k == 3)
    over = lambda a, b: [(x, z) for x, z in taken[bisect_right(ends, a) : bisect_left(starts, b)] if z > a]
    found = set()
    for s, e in stretches:
        part, near, k, tokens = text[s:e], over(s, e), 0, []
        for m in _TOKEN.finditer(part):
            a, b = s + m.start(), s + m.end()
            while k < len(near) and near[k][1] <= a:
                k += 1
            if not any(x < b and a < z for x, z in near[k : k + 8]):
                tokens.append(m.span())
        phones = tuple(z - s for z in phone_ends[bisect_right(phone_ends, s) : bisect_left(phone_ends, e)])
        for y, i, j in model.decode(part, tokens, phones):
            a, b = s + tokens[i][0], s + tokens[j - 1][1]
            if not over(a, b):
                found.add((y - 1, a, b))
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, model: SemiMarkov, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, numbers of base spans, their digest, and all spans; one pass, no shuffle."""
    names = [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            rows: list[list] = [[] for _ in names[1:]]
            for t in batch.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                every = sorted([*base, *added_spans(text, base, model)])
                kinds = [k for k, _, _ in base]
                for column, x in zip(rows, (*(kinds.count(k) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)), strict=True):
                    column.append(x)
            columns = [pa.array(c, pa.int64()) for c in rows[:4]] + [pa.array(c, pa.string()) for c in rows[4:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    d = docs.select(id_col, text_col)
    kind = dict(d.dtypes)[id_col]
    return d.mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n in names[1:5]) + ", base_sha256 string, spans string")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), trained())
