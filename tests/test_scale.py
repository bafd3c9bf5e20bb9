"""What replaces quadratic or gathering forms: each against a plain form on random rows."""

import random

import pytest
from pyspark.sql import functions as F

from privlake.functions import distance
from privlake.operators import catalog, evaluate, merge, selection, similar, sweep
from privlake.operators.overlap import overlap_join
from privlake.schema import ENTITIES_DDL


def candidates(r, n, length):
    one = lambda: (r.choice("AB"), a := r.randrange(length), a + r.choice((0, 1, 2, 5, 9)), "v", r.choice((0.5, 0.9, 0.1234564)), r.choice(("regle", "ner", "fusion")), r.random() < 0.3)
    return [one() for _ in range(n)]


def test_three_forms_of_arbitration_agree(spark):
    r = random.Random(8)
    docs = [candidates(r, r.randint(0, 40), r.choice((10, 60, 400))) for _ in range(400)] + [None, []]
    d = spark.createDataFrame(list(enumerate(docs)), f"i int, c {ENTITIES_DDL}")
    d = d.select("i", merge._folded(F.col("c")).alias("plain"), merge.arbitrate(F.col("c")).alias("cut"), merge.arbitrate_many(F.col("c")).alias("swept"))
    for row in d.collect():
        if docs[row.i] is None:
            assert row.cut is None and row.swept is None
        else:
            assert row.plain == row.cut == row.swept, docs[row.i]


def test_many_candidates(spark):
    r = random.Random(9)
    docs = [candidates(r, n, 4 * n) for n in (600, 20_000, 100_000)] + [candidates(r, 3000, 500)]
    d = spark.createDataFrame(list(enumerate(docs[:3])), f"i int, c {ENTITIES_DDL}").select("i", merge.arbitrate(F.col("c")).alias("e"))
    assert {row.i: [tuple(e) for e in row.e] for row in d.collect()} == {i: sweep.arbitrated(x) for i, x in enumerate(docs[:3])}
    assert 0 < len(sweep.arbitrated(docs[3])) < 3000


def test_overlap_join(spark):
    r = random.Random(1)
    side = lambda n: [(r.choice(["a", "b", "tout", None]), i, a := r.randrange(100_000), a + r.choice((0, 1, 7, 64, 65, 3000, 90_000))) for i in range(n)]
    left, right = side(300), [*side(300), ("a", 900, None, 5), ("a", 901, 9, 3)]
    schema = "doc string, n int, debut int, fin int"
    got = overlap_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["doc"])
    want = sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[0] is not None and y[2] is not None and y[2] <= y[3] and x[2] < y[3] and y[2] < x[3])
    assert sorted(map(tuple, got.select("gauche.n", "droite.n").collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("tolerance", [0.0, 0.2, 0.25, 0.4])
def test_similar_join_equals_all_pairs(spark, tolerance):
    r = random.Random(3)

    def noisy(v):
        v = list(v)
        for _ in range(r.randrange(4)):
            k = r.randrange(len(v) + 1)
            v[k : k + r.randrange(2)] = r.choice(["", "a", "b", "xy"])
        return "".join(v)

    words = ["".join(r.choice("ab c") for _ in range(r.choice((0, 1, 2, 3, 4, 5, 8, 13)))) for _ in range(80)] + ["aaaaaaaa", None]
    left = [(r.choice("de"), i, w) for i, w in enumerate(words * 2)]
    right = [(r.choice("de"), i, None if w is None else noisy(w)) for i, w in enumerate(words)]
    schema = "doc string, n int, valeur string"
    d = similar.similar_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["doc"], "valeur", tolerance)
    got = {(x.a, x.b): x.score for x in d.select(F.col("gauche.n").alias("a"), F.col("droite.n").alias("b"), "score").collect()}

    def score(a, b):
        return 1.0 if not a and not b else 0.0 if not a or not b else 1 - distance.distance(a, b) / max(len(a), len(b))

    want = {(x[1], y[1]): s for x in left for y in right if x[0] == y[0] and x[2] is not None and y[2] is not None and (s := score(x[2], y[2])) >= 1 - tolerance}
    assert got == want


def test_similar_join_compares_few_pairs(spark):
    r = random.Random(1)
    d = spark.createDataFrame([("doc", "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) + ".sn") for _ in range(1500)], "doc string, valeur string")
    assert similar.candidates(d, d, ["doc"], "valeur", 0.2).count() < 2 * 1500  # of two million


def test_banded_distance(spark):
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcde é😀") for _ in range(n))
    rows = [(text(n), text(n + r.randint(-3, 3))) for n in (3, 20, 200, 700)] + [(x := text(2000), x[:700] + "zz" + x[900:]), ("", ""), (x, None), (x, "")]
    d = spark.createDataFrame(rows, "a string, b string").select("a", "b", distance.levenshtein(F.col("a"), F.col("b")).alias("d"), F.levenshtein("a", "b").alias("w"), distance.levenshtein(F.col("a"), F.col("b"), 300).alias("m"))
    for x in d.collect():
        assert x.d == x.w and x.m == (x.w if x.w is not None and x.w <= 300 else None), x
    long = text(100_000)
    edited = list(long)
    for k in r.sample(range(len(edited)), 300):
        edited[k] = "#"
    assert distance.distance(long, "".join(edited)) == 300


def test_order_statistics(spark):
    r = random.Random(2)
    rows = [(r.choice(["x", "x", "x", "y", None]), r.choice((0.0, 0.5, r.random()))) for _ in range(5000)] + [("seul", 0.25), ("vide", None)]
    d = spark.createDataFrame(rows, "condition string, cer double").repartition(6)
    got = {x.condition: x for x in evaluate.error_summary(d).collect()}
    for k in {c for c, _ in rows}:
        v = sorted(x for c, x in rows if c == k and x is not None)
        if not v:
            assert got[k].n == 0 and got[k].p90 is None and got[k].moyenne is None
            continue
        n = len(v)
        assert (got[k].n, got[k].p90, got[k].mediane) == (n, v[min(n - 1, int(0.9 * n))], (v[(n - 1) // 2] + v[n // 2]) / 2) and abs(got[k].moyenne - sum(v) / n) < 1e-12
    far = selection.order_statistics(d, "condition", "cer", {"a": F.lit(10**9)})
    assert all(x.a is None for x in far.collect())


def snapshot(spark, n):
    return spark.range(n).select(
        F.concat(F.lit("d"), "id").alias("id"), F.lit("decouvert").alias("statut"), F.lit(0).cast("smallint").alias("tentatives"), F.lit(None).cast("string").alias("motif_echec"),
    )


def test_bucketed_catalogue_touches_what_changes(spark, tmp_path):
    path, old = str(tmp_path / "c"), snapshot(spark, 500)
    catalog.create_bucketed(old, path, "id", 16)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "c").rglob("*.parquet")}
    change = spark.createDataFrame([("d7", "echec", "panne"), ("d7", "decouvert", None)], "id string, statut string, motif string")
    touched = catalog.change_bucketed(spark, path, old.schema, "id", 16, change, catalog.update_status)
    assert len(touched) == 1 and len(before) == 16
    same = {p for p in (tmp_path / "c").rglob("*.parquet") if before.get(p) == p.stat().st_mtime_ns}
    assert len(same) == 15 and all(f"{catalog.BUCKET}={touched[0]}" not in str(p) for p in same)
    now = catalog.bucketed(spark, path, old.schema)
    rows = {r.id: (r.statut, r.tentatives, r.motif_echec) for r in now.collect()}
    assert len(rows) == 500 and rows.pop("d7") == ("echec", 1, "panne") and set(rows.values()) == {("decouvert", 0, None)}
    plan = now.where(F.col(catalog.BUCKET) == touched[0])._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull({catalog.BUCKET}" in plan
    assert catalog.change_bucketed(spark, path, old.schema, "id", 16, change.limit(0), catalog.update_status) == []


def test_a_failed_change_leaves_the_catalogue(spark, tmp_path):
    path, old = str(tmp_path / "c"), snapshot(spark, 50)
    catalog.create_bucketed(old, path, "id", 4)
    change = spark.createDataFrame([("d1", "echec", "x")], "id string, statut string, motif string")
    broken = lambda rows, changes: rows.withColumn("statut", F.raise_error(F.lit("panne")).cast("string"))
    with pytest.raises(Exception, match="panne"):
        catalog.change_bucketed(spark, path, old.schema, "id", 4, change, broken)
    assert catalog.bucketed(spark, path, old.schema).where("statut = 'decouvert'").count() == 50


def test_repeated_updates_are_one(spark):
    old = snapshot(spark, 3)
    twice = spark.createDataFrame([("d1", "echec", "a"), ("d1", "echec", "b"), ("d1", "en_analyse", None)], "id string, statut string, motif string")
    rows = {r.id: r for r in catalog.update_status(old, twice).collect()}
    assert len(rows) == 3 and (rows["d1"].statut, rows["d1"].tentatives, rows["d1"].motif_echec) == ("echec", 1, "b")
    queue = spark.createDataFrame([("d1", 0, None)], catalog.QUEUE)
    done = spark.createDataFrame([("d1", False), ("d1", True), ("d1", False)], "document_id string, reussi boolean")
    assert catalog.finish_analyses(queue, done, "2024-01-01").count() == 0
