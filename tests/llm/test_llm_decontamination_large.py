"""A benchmark beyond the broadcast bound gives the same hits, and its places travel without their texts."""

import random
import re

from pyspark.sql import functions as F

from privlake.llm import decontamination as dc
from privlake.llm import lm_scoring, toxicity


def corpus(spark):
    r = random.Random(4)
    word = lambda: r.choice("un deux trois quatre cinq six sept huit".split())
    bench = [(i, " ".join(word() for _ in range(r.choice((0, 1, 3, 5, 13, 20, 40))))) for i in range(30)] + [(99, None)]
    docs = []
    for i in range(120):
        text = [word() for _ in range(r.randint(0, 60))]
        for _ in range(r.randrange(3)):
            text[(k := r.randint(0, len(text))) : k] = (r.choice(bench)[1] or "").split()
        docs.append((i % 100, " ".join(text)))
    docs += [docs[3], (None, docs[4][1]), (None, None), (5, "")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")


def test_both_branches_agree(spark):
    docs, bench = corpus(spark)
    rows = lambda d: sorted(map(str, d.collect()))
    key = [F.col("doc_id"), F.xxhash64("text"), F.length("text")]
    for n in (13, 3):
        small, large = (dc.hits(docs, bench, key, n, broadcast_windows=b) for b in (10**9, 0))
        assert rows(small) == rows(large) and small.count() > 10
    assert dc.hits(docs.limit(0), bench, key, broadcast_windows=0).count() == 0


def test_places_travel_without_texts(spark):
    docs, bench = corpus(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        d = dc.hits(docs, bench, [F.col("doc_id"), F.xxhash64("text"), F.length("text")], broadcast_windows=0)
        plan = d._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    by_hash = [i for i, x in enumerate(lines) if re.search(r"Exchange hashpartitioning\(k#\d+, g#", x)]
    assert by_hash
    for i in by_hash:
        below = next((x for x in lines[i + 1 :] if "Project" in x or "HashAggregate" in x or "Union" in x), "")
        # the benchmark's own windows are grouped by a column of that name
        assert "Aggregate" in below or not re.search(r"[\[ ]w#\d+[,\]]", below), below  # as a column; a slice of it may be one


def test_spared_hits_in_one_pass():
    m = toxicity.Model({" idiot ": 2.0, " scum": 1.0}, ("pond scum", "idiot savant"))
    r = random.Random(1)
    text = " ".join(r.choice(["idiot", "savant", "pond", "scum", "x"]) for _ in range(4000))
    folded = toxicity.fold(text)
    total, _, most = m.features(folded)
    starts = [i for i in range(len(folded)) if folded.startswith(" idiot ", i) or folded.startswith(" scum", i)]
    spared = [(i, i + len(toxicity.fold(e)) - 1) for e in m.exceptions for i in range(len(folded)) if folded.startswith(toxicity.fold(e), i)]
    hits = [2.0 if folded.startswith(" idiot ", i) else 1.0 for i in starts if not any(a <= i < b for a, b in spared)]
    import math

    assert math.isclose(total, math.log1p(sum(hits))) and most == max(hits, default=0.0)
    import time

    began = time.time()
    m.features(toxicity.fold("idiot pond scum " * 70_000))  # a megabyte
    assert time.time() - began < 20


def test_scores_where_no_decision_hits(spark):
    """Anchors that are shared, and no word after them that is: the counts of hits stay doubles."""
    tail = lambda i: " ".join(f"v{i}x{k}" for k in range(40))
    head = " ".join(f"w{k}" for k in range(60))
    d = spark.createDataFrame([(i, f"{head} {tail(i)}") for i in range(1, 9)] + [(10 + i, tail(100 + i)) for i in range(30)], "doc_id long, text string")
    out = lm_scoring.score(d.repartition(3)).toPandas()
    assert len(out) == 38 and (out.score < 0).all()
    alone = lm_scoring.score(d.where("doc_id >= 10")).toPandas()
    assert len(alone) == 30 and (alone.score < 0).all()
