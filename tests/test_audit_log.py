"""The audit log in shards, and appends by several writers."""

import datetime as dt
import random
import threading

import pytest
from pyspark.sql import functions as F

from privlake.functions import spans as sp
from privlake.operators import audit, protect
from privlake.schema import ENTITIES_DDL


def events(spark, n, shards=1):
    given = "ordre long, horodatage timestamp, utilisateur_id string, role_effectif string, document_id string, action string, politique_appliquee string, niveau_en_cause string, adresse_ip string, details string, partie string"
    r = random.Random(n)
    rows = [(i, dt.datetime(2024, 1, 1, 0, 0, i % 60, 1000 * i), f"u{i % 3}", None, None, r.choice("ab"), None, None, None, "{}", r.choice(["x", "y", None][:shards])) for i in range(n)]
    return spark.createDataFrame(rows, given)


def test_a_chain_for_each_shard(spark):
    log = audit.append_by(events(spark, 200, 3), "partie").persist()
    for shard in ("x", "y", None):
        one = log.where(F.col("partie").eqNullSafe(F.lit(shard)))
        alone = audit.verify(one.drop("partie")).first()
        assert alone.intact and alone.nb_entrees == one.count() and {r.id for r in one.collect()} == set(range(1, one.count() + 1))
    got = {r.partie: r for r in audit.verify(log, block=8, by="partie").collect()}
    assert set(got) == {"x", "y", None} and all(r.intact for r in got.values())
    broken = log.withColumn("action", F.when((F.col("partie") == "x") & (F.col("id") == 20), "z").otherwise(F.col("action")))
    got = {r.partie: (r.intact, r.premiere_rupture, r.nb_entrees) for r in audit.verify(broken, block=8, by="partie").collect()}
    assert got["x"] == (False, 20, 20) and got["y"][0] and got[None][0]


def test_chains_go_on_from_their_heads(spark):
    rows = events(spark, 90, 2)
    whole = audit.append_by(rows, "partie")
    first = audit.append_by(rows.where("ordre < 40"), "partie").persist()
    heads = first.groupBy("partie").agg(F.max("id").alias("id"), F.max_by("empreinte", "id").alias("empreinte"))
    both = first.unionByName(audit.append_by(rows.where("ordre >= 40"), "partie", heads))
    key = lambda d: sorted((r.partie, r.id, r.empreinte) for r in d.collect())
    assert key(both) == key(whole)


def read(spark, path):
    return spark.read.parquet(path).drop("part")


def test_a_head_that_moves_is_met_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    assert audit.append_to(path, events(spark, 5)) == 1
    true, stale = audit.head, [(0, 0, None)] * 2
    monkeypatch.setattr(audit, "head", lambda s, p: stale.pop() if stale else true(s, p))  # twice behind another writer
    assert audit.append_to(path, events(spark, 4)) == 2
    v = audit.verify(read(spark, path)).first()
    assert v.intact and v.nb_entrees == 9
    monkeypatch.setattr(audit, "head", lambda s, p: (0, 0, None))
    with pytest.raises(audit.HeadMoved):
        audit.append_to(path, events(spark, 3))
    assert read(spark, path).count() == 9 and not [p for p in (tmp_path / "log").iterdir() if p.name.startswith("_")]


def test_writers_at_once(spark, tmp_path):
    path, done = str(tmp_path / "log"), []
    writers = [threading.Thread(target=lambda n=n: done.append(audit.append_to(path, events(spark, n), tries=20))) for n in (3, 4, 5)]
    for w in writers:
        w.start()
    for w in writers:
        w.join(120)
    v = audit.verify(read(spark, path)).first()
    assert sorted(done) == [1, 2, 3] and v.intact and v.nb_entrees == 12


def test_offsets_by_binary_search(spark):
    r = random.Random(1)
    tables = [sorted(r.choices(range(40), k=r.randint(1, 30))) for _ in range(60)]
    d = spark.createDataFrame([(t, o) for t in tables for o in (0, 7, 39, 41)], "t array<int>, o int").select("t", "o", sp.from_source(F.col("o"), F.col("t")).alias("p"))
    assert all(x.p == sum(v < x.o for v in x.t) for x in d.collect())


def test_rewriting_against_plain_forms(spark):
    r = random.Random(2)
    docs = []
    for _ in range(150):
        text = "".join(r.choice("abé😀 ") for _ in range(r.randint(0, 30)))
        spans = [("A", a := r.randint(0, 30), a + r.randint(0, 6), "v", 0.5, "regle", False) for _ in range(r.randint(0, 6))]
        docs.append((text, spans))
    d = spark.createDataFrame(docs, f"t string, e {ENTITIES_DDL}")
    tag = lambda e: F.concat(F.lit("<"), e["debut"].cast("string"), F.lit(">"))
    for row in d.select("t", "e", protect.rewrite(F.col("t"), F.col("e"), tag).alias("one"), protect.rewrite(F.col("t"), F.col("e"), tag, union=True).alias("all")).collect():
        out, end = row.t, len(row.t) + 1
        for _, e in sorted(enumerate(row.e), key=lambda x: (-x[1].debut, x[0])):
            if e.debut < e.fin <= min(len(row.t), end):
                out, end = f"{out[: e.debut]}<{e.debut}>{out[e.fin :]}", e.debut
        assert row.one == out
        out, at = "", 0
        for e in sorted(row.e, key=lambda e: (e.debut, e.fin)):
            if e.debut >= at:
                out += f"{row.t[at : e.debut]}<{e.debut}>"
            at = max(at, e.fin)
        assert row.all == out + row.t[at:]
