"""Whitening, centroid clustering and fingerprints against brute force; nulls, ties, repeats, empties, clashing names."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from privlake.llm import centroid_clustering, fingerprint, whitening
from privlake.llm.vectors import quantised

CLASH = ("q", "x", "d", "n", "id", "digest", "cluster", "block", "salt", "a", "b", "h", "w", "place")


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(c) for c in CLASH})


@pytest.fixture(scope="module")
def some(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 0.3, (400, 64)) @ np.diag(np.linspace(0.3, 3, 64))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(base)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # a hot vector
    return rows + [(7, rows[7][1]), (None, rows[8][1])]


BAD = [(50, None), (51, []), (52, [1.0] * 63 + [None]), (53, [float("nan")] + [0.0] * 63), (54, [float("inf")] * 64)]


def quant(rows, shift=0):
    return [(i, tuple(int(math.floor(64 * float(np.float32(x)))) + shift for x in v)) for i, v in rows]


def test_whitening_is_that_of_the_covariance(spark, some):
    got = whitening.whiten(vectors(spark, some + BAD).repartition(7)).toPandas()
    q = quant(some, 1_000_000)
    fit = np.array(sorted({v for _, v in q}), dtype=object)
    n, sums = len(fit), fit.sum(0)
    centred = (fit * n - sums).astype(float) / n
    values, v = np.linalg.eigh(centred.T @ centred / n)
    values, v = values[::-1][:16], v[:, ::-1][:, :16]
    assert len(got) == 16 * len(some) and set(got.n) == {n} and got.identity_error.max() < 1e-9
    first = got.drop_duplicates(["id", "component"]).dropna().pivot(index="id", columns="component", values="whitened")
    ids = [i for i, _ in q if i is not None]
    mine = {i: (np.array([a * n - s for a, s in zip(x, sums, strict=True)], dtype=float) / n) @ v / np.sqrt(values) for i, x in q if i is not None}
    want, have = np.array([mine[i] for i in first.index]), first.to_numpy()
    sign = np.sign((want * have).sum(0))
    assert np.allclose(want * sign, have, atol=1e-8) and len(first) == len(set(ids))
    explained = got.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(explained, values / np.trace(centred.T @ centred / n), rtol=1e-9)
    exact = {i: sum((a * n - s) ** 2 for a, s in zip(x, sums, strict=True)) for i, x in q}
    assert all(int(r.deviation) == exact[None if np.isnan(r.id) else int(r.id)] for r in got.itertuples())


def test_whitening_of_few_constant_or_mixed_vectors(spark):
    same = vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert whitening.whiten(same).count() == 0  # nothing varies
    two = whitening.whiten(vectors(spark, [(1, [0.0, 2.0, 5.0]), (2, [1.0, 2.0, 5.0]), (3, [0.5]), (4, [1.5]), (5, [1.5])])).toPandas()
    assert sorted(map(tuple, two[["id", "component", "n"]].values.tolist())) == [(1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 1, 2), (5, 1, 2)]
    assert np.allclose(np.abs(two.whitened), 1) and np.allclose(two.explained, 1)
    assert whitening.whiten(same.limit(0)).count() == 0


def test_exact_deviation_beyond_a_long(spark):
    m = whitening.Model(10**9, [10**15, 0], np.zeros((0, 2)), np.zeros(0), 0.0)
    x = np.array([[1_000_100, -40]])
    assert m.deviation(x) == [(1_000_100 * 10**9 - 10**15) ** 2 + (40 * 10**9) ** 2]


def test_an_r_of_many_partitions(spark, some):
    fit = spark.createDataFrame([(64, list(v)) for v in sorted({v for _, v in quant(some)})], "d int, x array<long>").repartition(40)
    fit = whitening.stored(fit)
    one, many = (whitening.fit(d, 16, whitening.shared_dir(spark))[64] for d in (whitening.stored(fit.coalesce(1)), fit))
    assert np.allclose(one.values, many.values, rtol=1e-12) and np.allclose(one.vectors, many.vectors, atol=1e-9)


def lloyd(rows, k, rounds):
    kept = [(i, v) for i, v in quant(rows) if len(v) == 64]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), hashlib.sha256(",".join(map(str, r[1])).encode()).digest()))
    c = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, row, strict=True)), i) for i, row in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        c = [[sum(v[i] for v in mine) // len(mine) for i in range(64)] if (mine := [v for (_, v), o in zip(kept, of, strict=True) if o == j]) else row for j, row in enumerate(c)]
    return Counter((i, *near(v)[::-1], ",".join(map(str, c[near(v)[1]]))) for i, v in kept)


@pytest.mark.parametrize(("k", "rounds"), [(16, 3), (3, 0)])
def test_clusters_are_those_of_plain_lloyd(spark, some, k, rounds):
    got = centroid_clustering.cluster(vectors(spark, some + BAD).repartition(5), k=k, rounds=rounds).collect()
    assert Counter((r.id, r.cluster, r.distance, ",".join(map(str, r.centroid))) for r in got) == lloyd(some, k, rounds)
    by = Counter()
    for r in got:
        by[r.cluster] += r.distance
    assert all(r.cluster_inertia == by[r.cluster] and r.inertia == sum(by.values()) for r in got)


def test_few_equal_or_no_vectors(spark):
    got = centroid_clustering.cluster(vectors(spark, [(1, [1.0] * 64), (2, [1.0] * 64), (3, [-0.01] * 64)] + BAD)).collect()
    assert {r.id: r.distance for r in got} == {1: 0, 2: 0, 3: 0} and len({r.cluster for r in got if r.id < 3}) == 1
    assert centroid_clustering.cluster(vectors(spark, BAD)).count() == 0
    best, d = centroid_clustering.nearest(np.array([[1 << 30, 1]]), [[0, 0], [1 << 29, 0]])  # beyond what doubles hold
    assert best.tolist() == [1] and d.tolist() == [(1 << 58) + 1]


def test_quantised_refuses_what_it_cannot_hold(spark):
    with pytest.raises(Exception, match="too large"):
        vectors(spark, [(1, [1e30])]).select(quantised(F.col("embedding"))).collect()


# --- fingerprints ---


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in CLASH})


def similarity(a, b):
    x, y = Counter(a.lower().split()), Counter(b.lower().split())
    return sum((x & y).values()) / sum((x | y).values())


def test_collisions_follow_weighted_similarity(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    pairs = []
    for i in range(60):
        a = rng.choice(words, 200, p=np.arange(400, 0, -1) / np.arange(401).sum()).tolist()
        b = a[: 200 - 3 * i] + rng.choice(words, 40 + i).tolist() + ["many"] * (i % 7) * 5
        pairs.append((i, " ".join(a), " ".join(b), 0))
    d = spark.createDataFrame(pairs, "k long, a string, b string, same int")
    f = fingerprint.fingerprints(d, ["k"], 64).select("k", fingerprint.likeness(F.col("a_codes"), F.col("b_codes")).alias("s"))
    got = {r.k: r.s for r in f.collect()}
    want = {k: similarity(a, b) for k, a, b, _ in pairs}
    gaps = np.array([got[k] - want[k] for k in want])
    assert abs(gaps.mean()) < 0.02 and np.abs(gaps).max() < 0.25 and np.corrcoef([got[k] for k in want], list(want.values()))[0, 1] > 0.95


def test_the_shared_start_changes_nothing(spark):
    text = "one two  three two\nfour five-six " * 9 + "tail"
    other = text[:150] + "nothing like it at all"
    d = spark.createDataFrame([(1, text, other, 0), (2, text, other, 150), (3, text, other, 147), (4, "", "a", 0), (5, "x", "x", 1), (6, " ", "", 0)], "k long, a string, b string, same int")
    got = {r.k: (r.a_codes, r.b_codes) for r in fingerprint.fingerprints(d, ["k"], 24).collect()}
    assert got[1] == got[2] == got[3] and got[4][0] is None and got[4][1] is not None and got[5][0] == got[5][1] and got[6] == (None, None)


ROWS = [(1, "a b c d e f"), (2, None), (3, ""), (70, "same words here"), (71, "same words here"), (71, "same words here"), (500_000, "é" * 10 + " 😀 x"), (-5, "last one"), (None, "no id"), (None, "no id")]


def test_edited_texts_and_neighbours(spark, tmp_path):
    documents(spark, ROWS).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = fingerprint.op12_fingerprint(spark, str(tmp_path)).collect()
    order = sorted((r for r in ROWS if r[0] is not None), key=lambda r: -r[0])
    want = Counter()
    for i, (doc, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 3
        want[doc, len(text), hashlib.sha256((text[: len(text) - k] + following[:k]).encode()).hexdigest()] += 1
    want[None, 5, hashlib.sha256(b"no i").hexdigest()] += 2
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert by[70].fingerprint == by[71].fingerprint != by[1].fingerprint and by[71].near_next == 1.0 and by[3].fingerprint == "" == by[2].fingerprint
    assert by[3].near_next == 1.0 and by[2].near_next == 0.0 and by[None].near_next == 0.0


def test_neighbours_across_blocks(spark):
    ids = [3 * i * i - 50 for i in range(300)]
    d = documents(spark, [(i, str(i)) for i in ids])
    got = {r.doc_id: r.next for r in fingerprint.neighbours(d.repartition(9)).where("NOT donor").collect()}
    order = sorted(ids, reverse=True)
    assert got == {a: str(b) for a, b in zip(order, [*order[1:], order[0]], strict=True)}


def test_no_documents_and_clashing_names(spark):
    assert fingerprint.neighbours(documents(spark, ROWS).limit(0)).count() == 0
    got = fingerprint.fingerprint(documents(spark, ROWS)).collect()
    assert len({r.fingerprint for r in got if r.doc_id in (70, 71)}) == 1
