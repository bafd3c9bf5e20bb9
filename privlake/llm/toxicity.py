"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded text.

Folding maps look-alike letters of other scripts and full-width forms to Latin,
digits and signs that stand for letters inside a word or at its end (but for
final exclamation marks) to those letters, lowers the case and drops soft hyphens and zero-width marks.  Lexicon entries are
words or word beginnings; an automaton finds all of them in one pass.  Hits
inside an exception phrase don't count: ``EXCEPTIONS``, and pairs of neighbouring
words that hold a lexicon entry and are as typical of the rows that aren't toxic
as an entry is of those that are.  The weights found, in sum and for each
word of the text, go through a logistic curve.

The lexicon and its weights are learnt from labelled rows: every word beginning
of 3 to 10 letters is a candidate, its weight is the log ratio of its smoothed
document frequencies in the two classes.  At most ``MAX_POSITIVE`` and
``MAX_NEGATIVE`` labelled rows are used, those with the lowest hash of the id, and
``MAX_CHARS`` characters in all (a bounded sample for a classifier); rows held
out are never used.

Edge cases: null or empty text has no hit and gets the curve's lowest score;
texts of any length are read whole; repeated rows are scored each; without
labelled rows of both classes every score is 0.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from privlake.llm.common import crc32_mod, table

MAX_POSITIVE, MAX_NEGATIVE = 3000, 6000
#: Characters of the sample in all; rows are taken in order of their hash while they fit.
MAX_CHARS = 60_000_000
MAX_ENTRIES = 2000
MIN_SUPPORT, MIN_WEIGHT = 4, 2.2
THRESHOLD = 0.7
MAX_EXCEPTIONS = 2000

#: Harmless phrases of words that also insult.
EXCEPTIONS = (
    "pond scum", "soap scum", "idiot proof", "idiot light", "april fool", "april fools", "fool proof", "fool s gold", "dumb terminal", "dumb waiter",
    "dumb bell", "dumb bells", "guinea pig", "guinea pigs", "pig iron", "lab rat", "lab rats", "rat race", "trash can", "trash cans", "trash bin", "trash bag",
    "trash bags", "trash collection", "garbage collector", "garbage collection", "garbage can", "garbage truck", "kill switch", "killer whale", "killer whales",
    "clown fish", "circus clown", "pathetic fallacy", "losers bracket", "loser s bracket",
)

#: Look-alikes of Latin letters: Greek and Cyrillic (fixed pairs, from, to).
_LOOKALIKE = (
    "аaеeоoрpсcуyхxіiјjѕsԁdһhмmтtкkвbнh"
    "αaοoρpυuνvιiκkτtχxεeıiɡg"
)
_DROP = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_FOLD = {ord(a): b for a, b in zip(_LOOKALIKE[::2], _LOOKALIKE[1::2], strict=True)}
_FOLD |= {0xFF01 + k: chr(0x21 + k) for k in range(94)} | _DROP
#: Digits and signs for letters, inside words that have a letter.
_LEET = str.maketrans("013457@$!", "oieastasi")


def fold(text: str) -> str:
    """Folded text: words of letters, each after one space, and one space at the end."""
    import re

    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    if _fold_re().search(text):
        text = re.sub(r"(?<![^\W_])[^\W\d_]*[0-9@$!]+[^\W\d_][^\W_@$!]*(?:[@$!]+[^\W_]+)*|[^\W\d_]+[0-9@$!]+[^\W\d_](?:[^\W_]|[@$!](?=[^\W_]))*", lambda m: m[0].translate(_LEET), text)
    if _end_gate_re().search(text):
        text = _end_re().sub(lambda m: m[0].translate(_LEET), text)
    return " " + " ".join(_words_re().findall(text)) + " "


def _fold_re():
    import re

    return _CACHED.setdefault("leet", re.compile(r"[0-9@$!][^\W\d_]"))


def _end_gate_re():
    import re

    return _CACHED.setdefault("end gate", re.compile(r"[^\W\d_][0-9@$!]"))


def _end_re():
    """Digits and signs from a letter to the word's end."""
    import re

    return _CACHED.setdefault("end", re.compile(r"(?<=[^\W\d_])(?:[013457@$]|!++(?=[013457@$]))++(?![^\W_])"))


def _words_re():
    import re

    return _CACHED.setdefault("words", re.compile(r"[^\W_]+"))


_CACHED: dict = {}


@dataclass
class Model:
    """``weights``: entry (" idiot", " idiot ") -> weight; a leading space means a word's start, a trailing one its end."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, ...] = (-20.0, 0.0, 0.0, 0.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for k, w in self.weights.items():
                a.add_word(k, (len(k), w))
            for k in self.exceptions:
                a.add_word(fold(k), (len(fold(k)), None))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def features(self, folded: str) -> tuple[float, float, float]:
        """Sum of weights (in logs), weight for each hundred words, greatest weight; one entry a word counts, the heaviest."""
        a = self.automaton()
        if not len(a):
            return 0.0, 0.0, 0.0
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, w) in a.iter(folded):
            start = end - n + 1
            if w is None:
                spared.append((start, end))
            elif w > best.get(start, 0.0):
                best[start] = w
        spared.sort()
        reach = list(accumulate((y for _, y in spared), max))
        hits = [w for s, w in best.items() if not ((k := bisect_left(spared, (s + 1,))) and s < reach[k - 1])]
        total, words = sum(hits), folded.count(" ") - 1
        import math

        return math.log1p(total), math.log1p(100.0 * total / max(words, 20)), max(hits, default=0.0)

    def score(self, text: str | None) -> float:
        import math

        b, *w = self.curve
        z = b + sum(x * y for x, y in zip(w, self.features(fold(text or "")), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve, "_automaton": None}


def learn(texts: list[str | None], labels: list[int], exceptions: tuple[str, ...] = ()) -> Model:
    """A model of labelled texts; the curve is fitted on halves that the weights didn't see."""
    import math
    import zlib

    import numpy as np

    folded = [fold(t or "") for t in texts]
    y = np.array(labels, dtype=float)
    if not 0 < y.sum() < len(y):
        return Model({}, exceptions)

    def entries(word: str) -> Iterator[str]:
        yield f" {word} "
        for n in range(3, min(len(word), 10) + 1):
            yield f" {word[:n]}"

    def lexicon(rows: list[int]) -> dict[str, float]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for i in rows:
            seen[int(y[i])].update({e for w in set(folded[i].split()) for e in entries(w)})
        n = [max(1, sum(1 for i in rows if y[i] == c)) for c in (0, 1)]
        found = {}
        for e, k in seen[1].items():
            if k < MIN_SUPPORT:
                continue
            w = math.log((k + 0.5) / (n[1] + 1) / ((seen[0][e] + 0.5) / (n[0] + 1)))
            if w >= MIN_WEIGHT:
                found[e] = (w * math.sqrt(k), w)
        # a beginning that nearly always continues in one way gives way to the longer entry
        for e in sorted(found, key=len, reverse=True):
            for n in range(4, len(e)):
                if e[:n] in found and seen[1][e] >= 0.8 * seen[1][e[:n]]:
                    del found[e[:n]]
        best = sorted(found, key=lambda e: (-found[e][0], e))[:MAX_ENTRIES]
        return {e: round(found[e][1], 4) for e in best}

    def benign(rows: list[int], weights: dict[str, float]) -> tuple[str, ...]:
        """The exceptions given, and those learnt from ``rows``."""
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        split = {i: folded[i].split() for i in rows}
        held = {w for w in set().union(*split.values()) if any(e in weights for e in entries(w))}
        for i, words in split.items():
            if held.isdisjoint(words):
                continue
            at = {j for k, w in enumerate(words) if w in held for j in (k - 1, k)}
            seen[int(y[i])].update({f"{words[j]} {words[j + 1]}" for j in at if 0 <= j < len(words) - 1})
        n = [max(1, sum(1 for i in rows if y[i] == c)) for c in (0, 1)]
        found = {}
        for p, k in seen[0].items():
            w = math.log((k + 0.5) / (n[0] + 1) / ((seen[1][p] + 0.5) / (n[1] + 1)))
            if k >= MIN_SUPPORT and w >= MIN_WEIGHT:
                found[p] = w * math.sqrt(k)
        return (*exceptions, *sorted(found, key=lambda p: (-found[p], p))[:MAX_EXCEPTIONS])

    def model(rows: list[int]) -> Model:
        weights = lexicon(rows)
        return Model(weights, benign(rows, weights))

    half = [zlib.crc32(t.encode()) & 1 for t in folded]
    x = np.zeros((len(folded), 3))
    for side in (0, 1):
        m = model([i for i, h in enumerate(half) if h != side])
        for i, h in enumerate(half):
            if h == side:
                x[i] = m.features(folded[i])
    curve = _logistic(x, y)
    whole = model(list(range(len(folded))))
    return Model(whole.weights, whole.exceptions, tuple(curve))


def _logistic(x, y):
    """Newton steps for a logistic curve with a small ridge."""
    import numpy as np

    a = np.column_stack([np.ones(len(x)), x])
    b, ridge = np.zeros(4), np.diag([1e-6, 1e-2, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge
        step = np.linalg.solve(h, a.T @ (y - p) - ridge @ b)
        b = b + step
        if abs(step).max() < 1e-8:
            break
    return [float(v) for v in b]


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The bounded labelled sample (text, toxic): per class, the ids of the lowest hash."""
    known = labels.where(F.col("toxic").isin(0, 1)).where(F.col("doc_id").isNotNull()).where(crc32_mod(F.col("doc_id"), 3) != 1)
    by = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = [known.where(F.col("toxic") == c).select("doc_id", "toxic").orderBy(*by).limit(n) for c, n in ((1, MAX_POSITIVE), (0, MAX_NEGATIVE))]
    found = docs.select("doc_id", "text").join(F.broadcast(some[0].unionByName(some[1])), "doc_id")  # a row for each labelled id
    so_far = F.sum(F.length(F.coalesce("text", F.lit("")))).over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("so_far", so_far).where(F.col("so_far") <= MAX_CHARS).select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    rows = sorted((r.text or "", r.toxic) for r in sample(docs, labels).collect())  # at most MAX_POSITIVE + MAX_NEGATIVE
    return learn([t for t, _ in rows], [c for _, c in rows], EXCEPTIONS)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; one pass, no shuffle."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            s = [model.score(t.as_py()) for t in batch.column(2)]
            p = [int(v >= threshold) for v in s]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array(p, pa.int32())], ["doc_id", "held_out", "score", "predicted"]
            )

    d = docs.select("doc_id", (crc32_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    kind = dict(d.dtypes)["doc_id"]
    return d.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
