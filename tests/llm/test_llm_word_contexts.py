"""Bit predictors for running words: codes, counts, probabilities, and what word order is worth."""

import collections
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa

from privlake.llm import lm_scoring, word_contexts as wc
from pyspark import TaskContext

SF = "/root/testdata/sf0.01"


def model(seed=3, words=40):
    r = random.Random(seed)
    counts = sorted((r.randint(0, 60) for _ in range(words)), reverse=True)
    tokens = sum(counts) + 17
    code, bits = wc.Code(counts, tokens), wc.table_bits(tokens)
    lengths = np.array([r.randint(1, 30) for _ in range(40)])
    codes = np.array([r.choice((*range(words), 0x80000005, 0x80000009)) for _ in range(lengths.sum())], dtype=np.int64)
    tables = [np.zeros(1 << b, dtype=np.uint64) for b in bits]
    hs = wc.hashes(wc.before_in(codes, lengths))
    wc.count(tables, code, code.of(codes), hs, bits)
    return code, bits, tables, codes, lengths, hs


def test_codes_are_prefix_free():
    code = model()[0]
    words = [format(c, f"0{n}b") for c, n in zip(code.code.tolist(), code.length.tolist(), strict=True)]
    assert len(words) == code.other + 1 and all(not b.startswith(a) for a in words for b in words if a is not b)
    assert wc.Code([], 0).length.tolist() == [0] and wc.Code([1, 1], 2).of(np.array([0, 1, -1, 1 << 31])).tolist() == [0, 0, 0, 0]


def test_words_before():
    one, two, three = wc.before_in(np.arange(10, 17), np.array([4, 1, 2]))
    assert one.tolist() == [-1, 10, 11, 12, -1, -1, 15] and two.tolist() == [-1, -1, 10, 11, -1, -1, -1] and three.tolist() == [-1] * 3 + [10] + [-1] * 3


def test_counts_equal_brute_force():
    """Every decision of every place once in each order's table, in the slot of its own context."""
    code, bits, tables, codes, lengths, hs = model()
    want = [collections.Counter() for _ in bits]
    for i, s in enumerate(code.of(codes).tolist()):
        word = format(int(code.code[s]), f"0{int(code.length[s])}b") if code.length[s] else ""
        for k, bit in enumerate(word):
            for order, b in enumerate(bits):
                slot = int(wc._slots(hs[order][i : i + 1], np.array([int("1" + word[:k], 2)], dtype=np.uint64), b)[0])
                want[order][slot, bit == "1"] += 1
    for t, w in zip(tables, want, strict=True):
        ones, zeros = wc.unpacked(t)
        assert int(ones.sum()) == sum(n for (_, one), n in w.items() if one) and int(zeros.sum()) == sum(n for (_, one), n in w.items() if not one)
        assert all((ones if one else zeros)[slot] == n for (slot, one), n in w.items())


def test_symbols_sum_to_one():
    """In any context, whether it was seen or not, and whatever the histogram held."""
    code, bits, tables, codes, lengths, hs = model()
    found = wc.state_tables([tuple(x.astype(np.float32) for x in wc.unpacked(t)) for t in tables])
    histogram = np.zeros(2 * wc.CELLS)
    wc.observe(histogram, found, code, code.of(codes), hs, bits)
    assert histogram.sum() == code.length[code.of(codes)].sum()
    table, every = wc.costs_of(histogram), np.arange(code.other + 1)
    for at in (0, 7, len(codes) - 1):
        same = [np.full(len(every), h[at]) for h in hs]
        p = 10 ** wc.costs(found, table, code, every, same, bits, False)
        # a code that isn't full leaves some of the probability to no word
        full = sum(0.5 ** code.length)
        assert p.sum() <= 1 + 1e-9 and (full < 1 or abs(p.sum() - 1) < 1e-9) and (p > 0).all()


def test_left_out_is_without_the_place():
    """A place read without itself costs what it costs with tables that never had it."""
    code, bits, tables, codes, lengths, hs = model()
    s, at = code.of(codes), int(np.flatnonzero(code.length[code.of(codes)] > 0)[5])
    pick = [h[at : at + 1] for h in hs]
    histogram = np.random.default_rng(1).integers(0, 5, 2 * wc.CELLS)
    table = wc.costs_of(histogram)
    pairs = lambda ts: [tuple(x.astype(np.float32) for x in wc.unpacked(t)) for t in ts]
    own = [np.zeros_like(t) for t in tables]
    wc.count(own, code, s[at : at + 1], pick, bits)
    one = wc.costs(wc.state_tables(pairs(tables)), table, code, s[at : at + 1], pick, bits, True)
    assert all((a >= b).all() for t, o in zip(tables, own, strict=True) for a, b in zip(wc.unpacked(t), wc.unpacked(o), strict=True))
    less = wc.costs(wc.state_tables(pairs([t - o for t, o in zip(tables, own, strict=True)])), table, code, s[at : at + 1], pick, bits, False)
    assert abs(one[0] - less[0]) < 1e-12


def test_word_order_counts_without_copies(spark):
    """Held-out documents that share under 5 % of their shingles with training lose 0.1 log10 a token by shuffling."""
    rows = duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY 1").fetchall()
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    shingles = lambda t: {tuple((t or "").encode().lower().split()[k : k + 5]) for k in range(len((t or "").split()) - 4)}
    known = set().union(*(shingles(t) for i, t in rows if not held(i)))
    fresh = {i: t for i, t in rows if held(i) and shingles(t) and len(shingles(t) & known) < 0.05 * len(shingles(t))}
    r, ids = random.Random(5), (i for i in range(10**6, 10**7) if held(i))
    mixed = {}
    for i, t in fresh.items():
        words = t.split()
        r.shuffle(words)
        mixed[next(ids)] = (i, " ".join(words))
    df = spark.createDataFrame([*rows, *((k, t) for k, (_, t) in mixed.items())], "doc_id long, text string").repartition(8)
    out = {x.doc_id: x for x in lm_scoring.score(df).collect()}
    tokens = sum(out[i].n_tokens for i in fresh)
    assert (sum(out[i].score for i in fresh) - sum(out[k].score for k in mixed)) / tokens > 0.1


def test_tables_are_summed_and_learnt_off_the_driver(spark, monkeypatch):
    """op3_lm_scoring: sums over two parts of the texts are those over all, and the driver gets states and costs only."""
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(("ab", "cd", "ef", "gh", f"w{r.randint(0, 90)}")) for _ in range(r.randint(0, 60)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    words = sorted({w.encode() for _, t in rows for w in t.split()} | {b""})
    head = spark.sparkContext.broadcast((b"".join(words), np.array(list(map(len, words)))))
    code, bits = wc.Code([sum(t.split().count(w.decode()) for _, t in rows) or len(rows) for w in words], 5000), wc.table_bits(5000)
    coded = lambda texts: lm_scoring._coded(head, texts)
    sent = spark.sparkContext.broadcast(code)
    first = wc.summed(docs.where("doc_id % 3 > 0").select("text"), coded, bits, sent).cache()
    found = spark.sparkContext.broadcast((wc.sent(wc.gathered(first, bits)),))
    both = wc.summed(docs.where("doc_id % 3 = 0").select("text"), coded, bits, sent, found, first).cache()
    tables, texts = [np.zeros(1 << b, dtype=np.uint64) for b in bits], docs.select("text").toArrow()["text"]
    for codes, lengths in coded(texts):
        wc.count(tables, code, code.of(codes), wc.hashes(wc.before_in(codes, lengths)), bits)
    for got, want in zip(wc.gathered(both, bits), wc.state_tables([tuple(x.astype(np.float32) for x in wc.unpacked(t)) for t in tables]), strict=True):
        assert all((a == b).all() for a, b in zip(got, want, strict=True))
    learnt = wc.learnt_costs(both)
    assert len(learnt) == 2 * wc.CELLS and (learnt < 0).all()
    monkeypatch.setattr(wc, "costs_of", lambda h, of=wc.costs_of: of(h) if TaskContext.get() else None)
    monkeypatch.setattr(wc, "states", lambda order, ones, zeros, of=wc.states: of(order, ones, zeros) if len(ones) < 2 else None)
    assert lm_scoring.score(docs).where("score < 0").count() == len(rows)


def test_counts_are_packed_by_byte():
    for most, width in ((0, 1), (255, 1), (256, 2), (70_000, 4), (1 << 40, 8)):
        both = np.array([[0, 1, most], [2, 0, most // 3]], dtype=np.uint64)
        got, data = wc.packed(both)
        assert got == width and (wc.counts_of(data, 3, got) == both).all()
    sparse = np.random.default_rng(2).integers(0, 1000, (2, wc.CHUNK)) // 998
    as_they_were = (sparse[0].astype(np.uint64) + (sparse[1].astype(np.uint64) << np.uint64(32))).tobytes()
    assert len(wc.packed(sparse.astype(np.uint64))[1]) < 0.8 * len(pa.compress(as_they_were, codec="zstd", asbytes=True))
