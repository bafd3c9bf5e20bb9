"""LM scoring: online logistic context mixing over the running text.

A text is its words, then an end mark.  Each word is told by binary decisions:

- *phrases*: is it the word that training documents have after the same words
  before it?  Contexts start at anchors, places where a hash of the ``ANCHOR``
  words before says so (equal texts have equal anchors), and then grow by every
  word: 4, 5, 6, ... words back.  Their counts are kept whole, in tables dealt by
  anchor: what is gathered grows with the corpus.
- else it is a *known word*: the bits of its code, each predicted from counts in
  hashed contexts of the 0, 1, 2 and 3 words before (``word_contexts``), or, after
  the code that all others share, a word by its count less a discount, or a *new
  word*, which is spelt: its bytes and an end mark, each byte a few decisions of a
  code tree, predicted from counts in hashed contexts of the last 1, 2, 3, 4 and 6
  bytes.

Several predictors give a probability for a decision; they are mixed in the
logistic domain by weights that a gate selects and online gradient steps learn,
and an adaptive table refines the mix.  The decisions' probabilities multiply to
a probability of the text: ``score_bits`` in all, ``bits_per_byte`` by its length.

A training document is scored as if it had been left out: its own occurrence of
a phrase, of a bit of a word, and of each word, doesn't count.  So a document that occurs once
is told from one whose copy the corpus holds, and held-out documents compare.

What is learnt covers all training texts: word counts (shuffled, with local sums
first), phrase counts (equal segments are summed where they are read, then dealt
by anchor), the tables of word contexts (all words of all training texts, slots
grow with them up to 2^22 an order), the spelling tables (from the words met once, which stand for words
to come; letters repeat, so their size stops at 2^20 slots), and the mixers.
The phrase mixer learns from a histogram of all decisions, of fixed size; the
spelling mixer's weights are averaged over parts of the word table that depend on
the words alone.  Scores don't depend on how the input is partitioned but for
the order of floating-point sums (about 1e-6 of a score, tested).

Each distinct word is scored once.  The ``HEAD`` most frequent words are held by
every worker; the others' scores come back to their documents by a join.

Edge cases: null or empty text is the end alone; words and texts of any length
are read whole; repeated rows are scored each; null ids are kept and belong to
training where crc32('') says so; without training texts every word is new and
every decision of its spelling is even; bits_per_byte is null for no bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from privlake.llm import word_contexts as wc
from privlake.llm.common import crc32_mod, drop_kept, shared_dir, stored, table

HEAD = 200_000
#: (bytes of context, log2 of the table's slots) of the spelling's contexts.
CONTEXTS = ((0, 8), (1, 14), (2, 17), (3, 19), (4, 20), (6, 20))
CHUNK = 1 << 14
WORDS_A_TABLE, WORDS_A_MIXER = 1_000_000, 200_000
BATCH_WORDS = 20_000
GATES, LEVELS = 64, 24
FLUSH = 250_000

#: Words of an anchor's context; one place in EVERY is an anchor; words of a segment, at most (masks have 64 bits).
ANCHOR, EVERY, LONGEST = 4, 16, 64
SEGMENTS_A_PART = 150_000
#: Documents whose words are told apart together.
DOCS = 400


def _split(text: str | None) -> list[bytes]:
    """Words; bytes.lower and bytes.split know A-Z and ASCII white space only."""
    return (text or "").encode().lower().split()


# --- counts ---


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c_train, c_all) over (training, text); the end of a text is the empty word."""

    def run(batches) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        drop_kept()
        train, rest = Counter(), Counter()

        def flush():
            words = list(train.keys() | rest.keys())
            a, b = [train[w] for w in words], [rest[w] for w in words]
            train.clear()
            rest.clear()
            columns = [pa.array(words, pa.binary()), pa.array(a, pa.int64()), pa.array([x + y for x, y in zip(a, b, strict=True)], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["word", "c_train", "c_all"])

        for batch in batches:
            for training, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                to = train if training else rest
                to.update(_split(text.as_py()))
                to[b""] += 1
                if len(train) + len(rest) > FLUSH:
                    yield flush()
        if train or rest:
            yield flush()

    local = docs.select("training", "text").mapInArrow(run, "word binary, c_train long, c_all long")
    return local.groupBy("word").agg(F.sum("c_train").alias("c_train"), F.sum("c_all").alias("c_all"))


# --- decisions ---


def code_tree(frequency) -> list[tuple[list[int], list[int]]]:
    """For each byte (0 is the end mark; bytes count one more for the rare), its inner nodes and bits: Huffman's code."""
    import heapq

    heap = [(float(f) + 1.0, i) for i, f in enumerate(frequency)]
    heapq.heapify(heap)
    parent, n = {}, len(frequency)
    inner = n
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i], parent[j] = (inner, 0), (inner, 1)
        heapq.heappush(heap, (a + b, inner))
        inner += 1
    out = []
    for s in range(n):
        nodes, bits, at = [], [], s
        while at in parent:
            at, bit = parent[at]
            nodes.append(at - n)
            bits.append(bit)
        out.append((nodes[::-1], bits[::-1]))
    return out


class Decisions:
    """The binary decisions of a batch of words: ``bit``, ``word`` (index) and a slot in each context's table."""

    def __init__(self, words: list[bytes], tree):
        import numpy as np

        data = np.frombuffer(b"\0".join(words) + b"\0", dtype=np.uint8)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        starts = np.cumsum(lengths) - lengths
        place = np.arange(len(data)) - np.repeat(starts, lengths)
        size = np.array([len(n) for n, _ in tree])
        at = np.cumsum(size) - size
        nodes, bits = (np.concatenate([np.array(t[k]) for t in tree]) for k in (0, 1))
        n = size[data]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        entry = np.repeat(at[data], n) + within
        self.bit = bits[entry].astype(np.int8)
        node = (nodes[entry].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        self.word = np.repeat(np.repeat(np.arange(len(words)), lengths), n)
        self.slots, h, order = [], np.full(len(data), 0x51ED270B, dtype=np.uint64), 0
        for reach, bits_of in CONTEXTS:
            while order < reach:  # one byte further back, where the word goes so far
                order += 1
                h[order:] = np.where(place[order:] >= order, (h[order:] ^ data[:-order]) * np.uint64(0x100000001B3) + np.uint64(order), h[order:])
                if order >= place.max(initial=0):
                    order = max(order, reach)
            x = np.repeat(h, n) * np.uint64(0xD6E8FEB86659FD93) + node
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            self.slots.append((x >> np.uint64(64 - bits_of)).astype(np.int64))


class Tables:
    """Counts of ones and of all decisions by slot, for each context."""

    def __init__(self):
        import numpy as np

        self.ones = [np.zeros(1 << b, dtype=np.float32) for _, b in CONTEXTS]
        self.all = [np.zeros(1 << b, dtype=np.float32) for _, b in CONTEXTS]

    def add(self, d: Decisions, counts) -> None:
        import numpy as np

        c = np.asarray(counts, dtype=np.float64)[d.word]
        for k, slot in enumerate(d.slots):
            n = len(self.all[k])
            self.all[k] += np.bincount(slot, c, n).astype(np.float32)
            self.ones[k] += np.bincount(slot, c * d.bit, n).astype(np.float32)

    def inputs(self, d: Decisions, without=None):
        """Stretched predictions (contexts by decisions) and the gate; ``without`` 1 leaves out one own occurrence."""
        import numpy as np

        x = np.empty((len(CONTEXTS) + 1, len(d.bit)), dtype=np.float32)
        x[-1] = 0.3
        known = []
        for k, slot in enumerate(d.slots):
            n, ones = self.all[k][slot], self.ones[k][slot]
            if without is not None:
                n = np.maximum(n - without, 0)
                ones = np.clip(ones - without * d.bit, 0, n)
            x[k] = np.log((ones + 0.02) / (n - ones + 0.02))
            known.append(n)
        np.clip(x, -12, 12, out=x)
        whole, near = (np.log2(n + 1).astype(np.int64) for n in (known[-1], known[-3]))
        return x, np.minimum(whole, 15) * 4 + np.minimum(near, 11) // 3


def _squash(z):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(z, -16, 16)))


class Mixer:
    """Weights by gate for a number of inputs (the last is a constant), and the refinement's counts by gate and level."""

    def __init__(self, inputs: int = len(CONTEXTS) + 1, gates: int = GATES):
        import numpy as np

        self.gates = gates
        self.w = np.full((gates, inputs), 0.2)
        self.w[:, -1] = 0
        self.square = np.full(self.w.shape, 1e-4)
        self.hit = np.full((gates, LEVELS), 0.0)
        self.seen = np.full((gates, LEVELS), 0.0)

    def mix(self, x, gate):
        import numpy as np

        return np.clip(np.einsum("kn,nk->n", x, self.w[gate]), -16, 16)

    def _level(self, z):
        import numpy as np

        return np.clip(((z + 12) * (LEVELS / 24)).astype(np.int64), 0, LEVELS - 1)

    def learn(self, x, gate, bit, weight, rate: float = 0.02, block: int = 4096) -> None:
        """Online steps, a block of decisions at a time: the gradient of the cost in bits by gate, scaled by its past size."""
        import numpy as np

        for a in range(0, len(bit), block):
            s = slice(a, a + block)
            g, z = gate[s], self.mix(x[:, s], gate[s])
            err = (bit[s] - _squash(z)) * weight[s]
            total = np.bincount(g, weight[s], self.gates) + 1e-9
            scale = np.sqrt(total * total.mean())
            for k in range(x.shape[0]):
                step = np.bincount(g, err * x[k, s], self.gates) / scale
                self.square[:, k] += step * step
                self.w[:, k] += rate * step / np.sqrt(self.square[:, k])

    def observe(self, x, gate, bit, weight) -> None:
        import numpy as np

        at = gate * LEVELS + self._level(self.mix(x, gate))
        self.hit += np.bincount(at, weight * bit, self.gates * LEVELS).reshape(self.hit.shape)
        self.seen += np.bincount(at, weight, self.gates * LEVELS).reshape(self.seen.shape)

    def probability(self, x, gate, bit):
        """Of the decisions taken: the mix and its refinement, averaged."""
        import numpy as np

        z = self.mix(x, gate)
        p, level = _squash(z), self._level(z)
        refined = (self.hit[gate, level] + 4 * p) / (self.seen[gate, level] + 4)
        p = np.clip((p + refined) / 2, 1e-6, 1 - 1e-6)
        return np.where(bit == 1, p, 1 - p)


# --- spelling of new words ---


def _batches(batches, columns: int) -> Iterator[list[list]]:
    for batch in batches:
        for a in range(0, batch.num_rows, BATCH_WORDS):
            part = batch.slice(a, BATCH_WORDS)
            yield [part.column(k).to_pylist() for k in range(columns)]


def _frequencies(words: DataFrame) -> list[int]:
    """Bytes of the training words, weighted; the end mark is byte 0."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(256)
        for w, c in _batches(batches, 2):
            data = np.frombuffer(b"\0".join(w) + b"\0", dtype=np.uint8)
            total += np.bincount(data, np.repeat(c, [len(x) + 1 for x in w]), 256)
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(total)], ["byte", "n"])

    rows = words.mapInArrow(run, "byte int, n double").groupBy("byte").agg(F.sum("n").alias("n")).collect()
    found = {r.byte: r.n for r in rows}
    return [found.get(b, 0.0) for b in range(256)]


def _tables(words: DataFrame, tree) -> DataFrame:
    """(context, chunk, ones, n): float32 sums as bytes, summed over the partitions of ``words``."""

    def run(batches):
        import pyarrow as pa

        t = Tables()
        for w, c in _batches(batches, 2):
            t.add(Decisions(w, tree), c)
        for k, (ones, n) in enumerate(zip(t.ones, t.all, strict=True)):
            for chunk, a in enumerate(range(0, len(n), CHUNK)):
                if n[a : a + CHUNK].any():
                    row = ([k], [chunk], [ones[a : a + CHUNK].tobytes()], [n[a : a + CHUNK].tobytes()])
                    yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["context", "chunk", "ones", "n"])

    def total(key, group):
        import numpy as np
        import pyarrow as pa

        ones, n = (sum(np.frombuffer(x.as_py(), dtype=np.float32) for x in group.column(c)) for c in ("ones", "n"))
        return pa.table({"context": pa.array([key[0].as_py()], pa.int32()), "chunk": pa.array([key[1].as_py()], pa.int32()), "ones": [ones.tobytes()], "n": [n.tobytes()]})

    schema = "context int, chunk int, ones binary, n binary"
    return words.mapInArrow(run, schema).groupBy("context", "chunk").applyInArrow(total, schema)


def _loaded(rows) -> Tables:
    import numpy as np

    t = Tables()
    for r in rows:
        a, n = r.chunk * CHUNK, len(r.n) // 4
        t.ones[r.context][a : a + n] = np.frombuffer(r.ones, dtype=np.float32)
        t.all[r.context][a : a + n] = np.frombuffer(r.n, dtype=np.float32)
    return t


def _mixer(words: DataFrame, tree, tables) -> Mixer:
    """Online steps over each partition, every word predicted without its own counts, and the refinement's counts of
    all words; weights averaged, counts summed."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        m, t, n = Mixer(), tables.value, 0
        for w, c in _batches(batches, 2):
            d = Decisions(w, tree)
            x, gate = t.inputs(d, without=1)
            weight = np.asarray(c, dtype=float)[d.word]
            m.learn(x, gate, d.bit, weight)
            m.observe(x, gate, d.bit, weight)
            n += len(w)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([m.w.tobytes()]), pa.array([m.hit.tobytes()]), pa.array([m.seen.tobytes()]), pa.array([n], pa.int64())], ["w", "hit", "seen", "n"])

    rows = words.mapInArrow(run, "w binary, hit binary, seen binary, n long").toLocalIterator()  # a few kB a partition
    import numpy as np

    m, total, w = Mixer(), 0, 0.0
    for r in rows:
        total += r.n
        w = w + np.frombuffer(r.w).reshape(m.w.shape) * r.n
        m.hit = m.hit + np.frombuffer(r.hit).reshape(m.hit.shape)
        m.seen = m.seen + np.frombuffer(r.seen).reshape(m.seen.shape)
    if total:
        m.w = w / total
    return m


def _in_parts(words: DataFrame, n: int, size: int) -> DataFrame:
    """``words`` in parts of about ``size``, and in an order, that depend on the words alone."""
    return words.repartition(max(1, -(-n // size)), "word").sortWithinPartitions(F.xxhash64("word"))


def scored_words(words: DataFrame, path: str) -> tuple[DataFrame, int, int]:
    """(word, c_train, c_all, lp_train, lp_held), the training tokens and their distinct words.

    The last columns are log10 of a word's probability where no phrase tells it: in a training document, without one
    of its occurrences, and in another.  Known words have their count less a discount (half of the words met once
    against those met twice); what the discounts leave goes to new words, which are spelt.
    """
    spark = words.sparkSession
    c = F.col("c_train")
    n, v, n1, n2 = words.agg(F.coalesce(F.sum(c), F.lit(0)), F.count_if(c > 0), F.count_if(c == 1), F.count_if(c == 2)).first()
    once = words.where("c_train = 1").select("word", "c_train")
    tree = code_tree(_frequencies(once))
    sums = stored(_tables(_in_parts(once, n1, WORDS_A_TABLE), tree), f"{path}/tables")
    tables = spark.sparkContext.broadcast(_loaded(sums.toLocalIterator()))  # of fixed size
    mixer = _mixer(_in_parts(once, n1, WORDS_A_MIXER), tree, tables)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for w, a, b in _batches(batches, 3):
            d = Decisions(w, tree)
            p = mixer.probability(*tables.value.inputs(d), d.bit)
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.bincount(d.word, np.log10(p), len(w)))], ["word", "c_train", "c_all", "spelt"])

    spelt = words.where("c_train <= 1").select("word", "c_train", "c_all").mapInArrow(run, "word binary, c_train long, c_all long, spelt double")
    every = spelt.unionByName(words.where("c_train > 1").select("word", "c_train", "c_all", F.lit(0.0).alias("spelt")))
    d = (n1 + 1) / (n1 + 2 * n2 + 2)
    left = d * v / n if n else 1.0
    new = F.col("spelt") + F.log10(F.lit(left))
    known = lambda less: F.log10((c - (less + d)) / F.lit(float(max(n, 1))))
    scored = every.select("word", "c_train", "c_all", F.when(c > 1, known(1)).otherwise(new).alias("lp_train"), F.when(c > 0, known(0)).otherwise(new).alias("lp_held"))
    return stored(scored, f"{path}/scored", "zstd"), n, v


# --- segments ---

_KINDS = (
    "key long, doc_id {kind}, training boolean, n_tokens long, n_bytes long, n_known long, logc double, logp double, "
    "word binary, place long, anchor long, h long, sidx int, codes binary, once boolean, before binary"
)


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cut(codes, lengths):
    """Segments of documents of ``lengths`` words, coded: (start of each, its document, its number there, anchor hash,
    hash of the whole, each word's segment, each word's place in it).

    A segment starts with a document, at an anchor, or ``LONGEST`` words after its start; the first has no context.
    """
    import numpy as np

    n = len(codes)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    pos = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    m = _mixed(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    context = np.zeros(n, dtype=np.uint64)
    for k in range(ANCHOR, 0, -1):
        context[ANCHOR:] = context[ANCHOR:] * np.uint64(0xD6E8FEB86659FD93) + m[ANCHOR - k : n - k]
    context = _mixed(context)
    start = (pos == 0) | ((pos >= ANCHOR) & ((context >> np.uint64(33)) % np.uint64(EVERY) == 0))
    off = np.arange(n) - np.maximum.accumulate(np.where(start, np.arange(n), 0))
    start |= off % LONGEST == 0
    off %= LONGEST
    begin = np.flatnonzero(start)
    segment = np.cumsum(start) - 1
    whole = np.add.reduceat(_mixed(m + off.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)), begin) if n else np.zeros(0, dtype=np.uint64)
    of = doc[begin]
    number = np.arange(len(begin)) - np.searchsorted(of, of)
    return begin, of, number, context[begin], _mixed(whole ^ context[begin]), segment, off


def _coded(head, texts) -> Iterator[tuple]:
    """(word codes, words of each text), so many documents at a time; the end of a text is a word."""
    import zlib

    import numpy as np

    index = head_of(head)[0]
    for a in range(0, len(texts), DOCS):
        words: list[bytes] = []
        lengths = []
        for text in texts[a : a + DOCS]:
            found = _split(text.as_py())
            found.append(b"")
            words += found
            lengths.append(len(found))
        codes = (index[w] if w in index else zlib.crc32(w) | 0x80000000 for w in words)
        yield np.fromiter(codes, dtype=np.int64, count=len(words)), np.array(lengths, dtype=np.int64)


def _contexts(docs: DataFrame, head, code, n: int, path: str):
    """Broadcast (states, costs, log2 of slots) of the words' predictors; ``docs`` are the training texts."""
    spark, bits = docs.sparkSession, wc.table_bits(n)
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(8)) == 0
    coded = lambda texts: _coded(head, texts)
    counts = stored(wc.summed(docs.where(~fold).select("text"), coded, bits, code), f"{path}/counts", "zstd")
    found = spark.sparkContext.broadcast((wc.sent(wc.gathered(counts, bits)),))
    sums = stored(wc.summed(docs.where(fold).select("text"), coded, bits, code, found, counts), f"{path}/fold", "zstd")
    found.destroy()
    return spark.sparkContext.broadcast((wc.sent(wc.gathered(sums, bits)), wc.learnt_costs(sums), bits))


def _rows(docs: DataFrame, head, code, contexts, path: str) -> DataFrame:
    """Rows of documents (sums over head words), of other words (key, training, word, place) and of segments (key,
    training, sidx, anchor, h, codes, once); ``codes`` has a number for each word, ``once`` marks a document's first
    segment of its kind, ``place`` is 64 times a segment's number and the place in it."""

    def run(batches) -> Iterator:
        import zlib
        from itertools import repeat

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        index, logc, extra_train, extra_held, known, _ = head_of(head)
        states, table, bits = wc.received(contexts)
        key = TaskContext.get().partitionId() << 33
        names = [x.split()[0] for x in _KINDS.split(", ")]

        def out(n: int, kind, **columns):
            types = [pa.int64(), kind, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns and not isinstance(columns[c], pa.Array) else columns.get(c, pa.nulls(n, t)) for c, t in zip(names, types, strict=True)], names)

        for whole in batches:
            for a in range(0, whole.num_rows, DOCS):
                batch = whole.slice(a, DOCS)
                training = np.array(batch.column(1).to_pylist(), dtype=bool)
                words: list[bytes] = []
                lengths, sizes = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
                for i, text in enumerate(batch.column(2)):
                    data = (text.as_py() or "").encode()
                    found = data.lower().split()
                    found.append(b"")
                    words += found
                    lengths[i], sizes[i] = len(found), len(data)
                codes = np.fromiter(map(index.get, words, repeat(-1)), dtype=np.int64, count=len(words))
                doc = np.repeat(np.arange(batch.num_rows), lengths)
                inside = codes >= 0
                at, by = codes[inside], doc[inside]
                total = lambda x: np.bincount(by, x, batch.num_rows).astype(float)  # noqa: E731, B023
                rest = np.flatnonzero(~inside)
                tail = [words[k] for k in rest.tolist()]
                codes[rest] = np.fromiter((zlib.crc32(w) | 0x80000000 for w in tail), dtype=np.int64, count=len(tail))
                symbol, hs, cost = code.value.of(codes), wc.hashes(wc.before_in(codes, lengths)), np.zeros(len(codes))
                for reading in (True, False):
                    mine = np.flatnonzero(training[doc] == reading)
                    cost[mine] = wc.costs(states, table, code.value, symbol[mine], [x[mine] for x in hs], bits, reading)
                keys = key + np.arange(batch.num_rows)
                key += batch.num_rows
                yield out(
                    batch.num_rows, batch.column(0).type, key=keys, doc_id=batch.column(0), training=training, n_tokens=lengths, n_bytes=sizes,
                    n_known=total(known[at]).astype(np.int64), logc=total(logc[at]), logp=total(np.where(training[by], extra_train[at], extra_held[at])) + np.bincount(doc, cost, batch.num_rows),
                )
                begin, of, number, anchor, h, segment, off = cut(codes, lengths)
                if tail:
                    s = segment[rest]
                    yield out(len(tail), batch.column(0).type, key=keys[doc[rest]], training=training[doc[rest]], word=pa.array(tail, pa.binary()), place=number[s] * LONGEST + off[rest])
                mine = np.flatnonzero(number > 0)
                if len(mine):
                    first = np.zeros(len(begin), dtype=bool)
                    first[mine[np.unique(_mixed(h[mine] + of[mine].astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)), return_index=True)[1]]] = True
                    ends = np.append(begin, len(codes)).astype(np.int32) * np.int32(4)
                    data = codes.astype("<u4").tobytes()
                    blobs = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)]).take(pa.array(mine))
                    reach = pa.py_buffer((np.arange(len(mine) + 1, dtype=np.int32) * np.int32(4 * wc.ORDERS)).tobytes())
                    ahead = pa.py_buffer(codes[begin[mine][:, None] - np.arange(1, wc.ORDERS + 1)].astype("<u4").tobytes())
                    yield out(
                        len(mine), batch.column(0).type, key=keys[of[mine]], training=training[of[mine]], sidx=number[mine].astype(np.int32),
                        anchor=anchor[mine].view(np.int64), h=h[mine].view(np.int64), codes=blobs, once=first[mine],
                        before=pa.Array.from_buffers(pa.binary(), len(mine), [None, reach, ahead]),
                    )

    kind = dict(docs.dtypes)["doc_id"]
    return stored(docs.select("doc_id", "training", "text").mapInArrow(run, _KINDS.format(kind=kind)), path, "zstd")


def head_of(head):
    """This worker's index of the head's words, and their numbers: log10 of the smoothed count, log10 of the probability
    beyond their code's in a training text and in another, whether training has them, class."""
    import numpy as np

    blob, lengths, *numbers = head.value
    if not hasattr(head, "_index"):
        ends = np.cumsum(lengths).tolist()
        head._index = {blob[e - n : e]: i for i, (e, n) in enumerate(zip(ends, lengths.tolist(), strict=True))}
    return head._index, *numbers


# --- phrases ---

#: Buckets of a decision's contexts: documents that have the context, those of them with another word, depth, what
#: the last decision was, class of the word foretold.
_COUNTS = (1, 2, 3, 4, 6, 10, 30)
_OTHERS = (0, 1, 2, 3, 5, 9, 20)
_DEPTHS = (0, 1, 2, 4, 7, 12, 24)
_SHAPE = (8, 8, 8, 3, 5)
CELLS = 8 * 8 * 8 * 3 * 5


def _local(segments: DataFrame) -> DataFrame:
    """(anchor, h, codes, before, t, d): equal segments of a partition summed, so that a common passage is a row a partition."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held, size = [], 0

        def flush():
            x = pa.Table.from_batches(held).combine_chunks()
            h = x.column("h").to_numpy()
            _, first, at = np.unique(h, return_index=True, return_inverse=True)
            t, d = (np.bincount(at, x.column(c).to_numpy().astype(float)).astype(np.int64) for c in ("t", "d"))
            y = x.take(pa.array(first))
            columns = [y.column(c).combine_chunks() for c in ("anchor", "h", "codes", "before")]
            return pa.RecordBatch.from_arrays([*(c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns), pa.array(t), pa.array(d)], ["anchor", "h", "codes", "before", "t", "d"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size > 400_000:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return segments.mapInArrow(run, "anchor long, h long, codes binary, before binary, t long, d long")


def foretold(anchor, codes, lengths, t, d, classes):
    """Decisions of segments (distinct; ``anchor`` a number each, ``codes`` flat) that t training documents, d in all, have.

    At every place the words so far are a context; the word that most training documents have after it is foretold
    (of equals the least code).  Two readings of each segment: of a training document, without itself, and of another.
    For each reading: (rows, depths, cells, hits) of all decisions, in order of depth.
    """
    import numpy as np

    start = np.cumsum(lengths) - lengths
    rows = np.arange(len(anchor))
    context = anchor.astype(np.int64)
    last = np.zeros((2, len(anchor)), dtype=np.int64)
    out: tuple[list, list] = ([], [])
    for depth in range(LONGEST):
        go = lengths[rows] > depth
        rows, context = rows[go], context[go]
        if not len(rows):
            break
        word, mine = codes[start[rows] + depth].astype(np.int64), t[rows]
        pairs, at = np.unique((context << 32) + word, return_inverse=True)
        count = np.bincount(at, mine, len(pairs)).astype(np.int64)
        of, w = pairs >> 32, pairs & 0xFFFFFFFF
        order = np.lexsort((w, -count, of))
        head = np.flatnonzero(np.concatenate([[True], of[order][1:] != of[order][:-1]]))
        place = np.searchsorted(of[order][head], context)  # contexts are numbered in order, but not all are here
        first = order[head][place]
        after = np.minimum(head + 1, len(order) - 1)
        second = order[after]
        has = (head + 1 < len(order)) & (of[second] == of[order[head]])
        second, has = second[place], has[place]
        n = np.add.reduceat(count[order], head)[place]
        c1, c2 = count[first], np.where(has, count[second], 0)
        # without the document itself
        less = c1 - (w[first] == word)
        other = has & ((c2 > less) | ((c2 == less) & (w[second] < w[first])))
        for reading, (who, all_, best, m) in enumerate((
            (mine > 0, n - 1, np.where(other, w[second], w[first]), np.where(other, c2, less)),
            (d[rows] > mine, n, w[first], c1),
        )):
            ok = np.flatnonzero(who & (all_ > 0) & (m > 0))
            hit = best[ok] == word[ok]
            cell = np.ravel_multi_index((
                np.searchsorted(_COUNTS, all_[ok]), np.searchsorted(_OTHERS, all_[ok] - m[ok]), np.searchsorted(_DEPTHS, np.full(len(ok), depth)), last[reading][rows[ok]],
                np.where(best[ok] < len(classes), classes[np.minimum(best[ok], len(classes) - 1)], 4) if len(classes) else np.full(len(ok), 4),
            ), _SHAPE)
            last[reading][rows[ok]] = np.where(hit, 1, 2)
            out[reading].append((rows[ok], np.full(len(ok), depth), cell, hit))
        # a context that only the document itself has tells it nothing
        alone = np.bincount(at, d[rows] > mine, len(pairs)) == 0
        go = (count[at] > 1) | ((count[at] == 1) & ~alone[at])
        rows, context = rows[go], at[go]
    return [tuple(np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (zip(*one, strict=True) if one else ((), (), (), ()))) for one in out]


def _phrases(segments: DataFrame, head, code, contexts, parts: int) -> DataFrame:
    """(anchor, h, t, mask_t, mask_h, told_t, told_h, cells_t, cells_h) of the segments that other documents foretell:
    the places told as bits, the log10 probabilities (by their contexts) that they save, and 2 * cell + hit of every decision."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        x = pa.Table.from_batches(held).combine_chunks()
        anchor, h, t, d = (x.column(c).to_numpy() for c in ("anchor", "h", "t", "d"))
        order = np.lexsort((h, anchor))
        new = np.concatenate([[True], (anchor[order][1:] != anchor[order][:-1]) | (h[order][1:] != h[order][:-1])])
        first = np.flatnonzero(new)
        t, d, pick = np.add.reduceat(t[order], first), np.add.reduceat(d[order], first), order[first]
        anchor, h = anchor[pick], h[pick]
        number = np.cumsum(np.concatenate([[True], anchor[1:] != anchor[:-1]])) - 1
        keep = np.flatnonzero((np.bincount(number, d)[number] > 1) & (np.bincount(number, t)[number] > 0))
        if not len(keep):
            return
        anchor, h, t, d, number = anchor[keep], h[keep], t[keep], d[keep], number[keep]
        blobs = x.column("codes").take(pa.array(pick[keep])).to_pylist()
        before = np.frombuffer(b"".join(x.column("before").take(pa.array(pick[keep])).to_pylist()), dtype="<u4").reshape(-1, wc.ORDERS).astype(np.int64)
        del x, held
        codes = np.frombuffer(b"".join(blobs), dtype="<u4")
        lengths = np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs)) // 4
        start = np.cumsum(lengths) - lengths
        _, _, *extra, _, classes = head_of(head)
        states, table, bits = wc.received(contexts)
        columns = [pa.array(anchor), pa.array(h), pa.array(t)]
        some = np.zeros(len(anchor), dtype=bool)
        found = []
        for (rows, depth, cell, hit), of in zip(foretold(number, codes, lengths, t, d, classes), extra, strict=True):
            by = np.argsort(rows, kind="stable")
            rows, depth, cell, hit = rows[by], depth[by], cell[by], hit[by].astype(bool)
            some[rows] = True
            mask = np.zeros(len(anchor), dtype=np.uint64)
            np.bitwise_or.at(mask, rows[hit], np.uint64(1) << depth[hit].astype(np.uint64))
            r, k = rows[hit], depth[hit]
            word = codes[start[r] + k].astype(np.int64)
            back = [np.where(k >= b, codes[np.maximum(start[r] + k - b, 0)], before[r, np.clip(b - 1 - k, 0, None)]) for b in range(1, wc.ORDERS + 1)]
            cost = wc.costs(states, table, code.value, code.value.of(word), wc.hashes(back), bits, not found)  # the first reading is of a training document
            told = np.bincount(r, cost + (np.where(word < len(of), of[np.minimum(word, len(of) - 1)], 0.0) if len(of) else 0.0), len(anchor)).astype(float)  # without a hit numpy counts in whole numbers
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(anchor)))]).astype(np.int32) * np.int32(2)
            data = (2 * cell + hit).astype("<u2").tobytes()
            found.append((pa.array(mask.view(np.int64)), pa.array(told), pa.Array.from_buffers(pa.binary(), len(anchor), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])))
        columns += [c for pair in zip(*found, strict=True) for c in pair]
        names = ["anchor", "h", "t", "mask_t", "mask_h", "told_t", "told_h", "cells_t", "cells_h"]
        yield from pa.table(columns, names=names).take(pa.array(np.flatnonzero(some))).to_batches(max_chunksize=20_000)

    schema = "anchor long, h long, t long, mask_t long, mask_h long, told_t double, told_h double, cells_t binary, cells_h binary"
    return _local(segments).repartition(parts, "anchor").mapInArrow(run, schema)


def word_classes(lp):
    """Class of each head word by its probability, 0 (frequent) to 3."""
    import numpy as np

    return np.searchsorted([2.0, 3.0, 4.0], -lp)


def phrase_costs(histogram):
    """log10 of the probability of each decision (2 * cell + hit) from the counts of all training decisions.

    Predictors are hit rates in parts of the cell, hashed contexts of the decision; weights by count and last
    decision mix them, and the cell's own counts refine the mix.
    """
    import numpy as np

    count = np.asarray(histogram, dtype=float).reshape(CELLS, 2)
    axes = np.array(np.unravel_index(np.arange(CELLS), _SHAPE))
    x = []
    for part in ((0, 1), (2, 3), (0, 4), (1, 3, 4), (0, 1, 2, 3)):
        key = np.ravel_multi_index(axes[list(part)], [_SHAPE[k] for k in part])
        n1, n = np.bincount(key, count[:, 1]), np.bincount(key, count.sum(1))
        x.append(np.log((n1 + 0.4) / (n - n1 + 0.4))[key])
    x = np.clip(np.array([*x, np.full(CELLS, 0.3)]), -12, 12)
    gate = axes[0] * 3 + axes[3]
    m = Mixer(len(x), 24)
    both, twice, bit, weight = np.concatenate([x, x], axis=1), np.tile(gate, 2), np.repeat([0, 1], CELLS), np.concatenate([count[:, 0], count[:, 1]])
    for _ in range(200):
        m.learn(both, twice, bit, weight, block=2 * CELLS)
    z = _squash(m.mix(x, gate))
    p = np.clip((count[:, 1] + 8 * z) / (count.sum(1) + 8), 1e-6, 1 - 1e-6)
    return np.log10(np.column_stack([1 - p, p])).ravel()


def _told(phrases: DataFrame) -> DataFrame:
    """(anchor, h, mask_t, mask_h, gain_t, gain_h): what the decisions of a segment cost, less what they save."""

    def counted(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total = np.zeros(2 * CELLS)
        for batch in batches:
            cells = [np.frombuffer(x, dtype="<u2") for x in batch.column(0).to_pylist()]
            weight = np.repeat(batch.column(1).to_numpy().astype(float), list(map(len, cells)))
            total += np.bincount(np.concatenate(cells), weight, 2 * CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])

    rows = phrases.select("cells_t", "t").mapInArrow(counted, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # a row a cell
    import numpy as np

    histogram = np.zeros(2 * CELLS)
    for r in rows:
        histogram[r.cell] = r.n
    costs = phrase_costs(histogram)

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            gains = []
            for told, cells in ((3, 5), (4, 6)):
                c = [np.frombuffer(x, dtype="<u2") for x in batch.column(cells).to_pylist()]
                by = np.repeat(np.arange(len(c)), list(map(len, c)))
                gains.append(np.bincount(by, costs[np.concatenate(c)], len(c)) - batch.column(told).to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 7, 8)), *map(pa.array, gains)], ["anchor", "h", "mask_t", "mask_h", "gain_t", "gain_h"])

    d = phrases.select("anchor", "h", "t", "told_t", "told_h", "cells_t", "cells_h", "mask_t", "mask_h")
    return d.mapInArrow(run, "anchor long, h long, mask_t long, mask_h long, gain_t double, gain_h double")


# --- documents ---


def score(docs: DataFrame, training=None, head_words: int = HEAD) -> DataFrame:
    """Scores of ``docs`` (doc_id, text); ``training`` is a Column, by default crc32(doc_id) mod 10 <> 0."""
    import numpy as np

    spark, base = docs.sparkSession, shared_dir(docs.sparkSession)
    training = crc32_mod(F.col("doc_id"), 10) != 0 if training is None else training
    docs = docs.select("doc_id", training.alias("training"), "text")
    words = stored(word_counts(docs), f"{base}/words", "zstd")
    words, n, v = scored_words(words, base)
    top = words.orderBy(F.desc("c_all"), "word").limit(head_words).select("word", "c_train", "lp_train", "lp_held").toArrow()  # HEAD rows at most
    c = top["c_train"].to_numpy().astype(float)
    word = top["word"].to_pylist()
    lp = [top[x].to_numpy().astype(float) for x in ("lp_train", "lp_held")]
    other = float(np.log10(max(1 - (10 ** lp[1][c >= 2]).sum(), 1e-9)))  # of all words without a code of their own
    numbers = (np.log10(c + 0.1), *(np.where(c >= 2, 0.0, x - other) for x in lp), (c > 0).astype(np.int64), word_classes(lp[1]))
    head = spark.sparkContext.broadcast((b"".join(word), np.array(list(map(len, word)), dtype=np.int64), *numbers))
    del top, word
    code = spark.sparkContext.broadcast(wc.Code(c, n))
    contexts = _contexts(docs.where("training"), head, code, n, base)
    rows = _rows(docs, head, code, contexts, f"{base}/rows")

    segments = rows.where("anchor IS NOT NULL")
    parts = max(1, -(-segments.count() // SEGMENTS_A_PART))
    once = segments.where("once").select("anchor", "h", "codes", "before", F.col("training").cast("long").alias("t"), F.lit(1).cast("long").alias("d"))
    told = _told(stored(_phrases(once, head, code, contexts, parts), f"{base}/phrases", "zstd"))
    mine = lambda c: F.when(F.col("training"), F.col(f"{c}_t")).otherwise(F.col(f"{c}_h"))
    seen = segments.select("key", "sidx", "training", "anchor", "h").join(told, ["anchor", "h"], "left")
    seen = seen.groupBy("key").agg(
        F.sum(F.coalesce(mine("gain"), F.lit(0.0))).alias("gain"), F.sort_array(F.collect_list(F.struct("sidx", F.coalesce(mine("mask"), F.lit(0)).alias("mask")))).alias("masks")
    )
    tail = rows.where("word IS NOT NULL").select("key", "training", "word", "place").join(words.drop("c_all"), "word")
    tail = tail.groupBy("key").agg(
        F.count_if(F.col("c_train") > 0).alias("k"), F.sum(F.log10(F.col("c_train") + 0.1)).alias("lc"),
        F.collect_list(F.struct("place", F.when(F.col("training"), F.col("lp_train")).otherwise(F.col("lp_held")).alias("p"))).alias("others"),
    )
    d = rows.where("n_tokens IS NOT NULL").select("key", "doc_id", "n_tokens", "n_bytes", "n_known", "logc", "logp").join(tail, "key", "left").join(seen, "key", "left")

    def told_by_phrase(place):
        # a document's segments have dense numbers from 1 on
        mask = F.coalesce(F.get("masks", F.floor(place / LONGEST).cast("int") - 1)["mask"], F.lit(0).cast("long"))
        return F.call_function("shiftright", mask, (place % LONGEST).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1

    others = F.aggregate("others", F.lit(0.0), lambda a, x: a + F.when(told_by_phrase(x["place"]), F.lit(0.0)).otherwise(x["p"] - other))
    or0 = lambda c: F.coalesce(c, F.lit(0.0))
    floor = float(np.log10(n + 0.1 * (v + 1)))
    d = d.select(
        "doc_id", (crc32_mod(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("logc") + or0(F.col("lc")) - F.col("n_tokens") * floor).alias("base_score"),
        (F.col("logp") + or0(others) + or0(F.col("gain"))).alias("score"), "n_bytes",
    )
    bits = -F.col("score") / float(np.log10(2))
    return d.withColumn("score_bits", bits).withColumn("bits_per_byte", F.when(F.col("n_bytes") > 0, bits / F.col("n_bytes")))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
