"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from privlake.llm import decontamination, jaccard_join, lm_scoring, packing, pii, quality_rules, secret_scan, token_output, toxicity, url_filter
from privlake.llm.common import shared_dir

LONG = "lorem ipsum 4111 dolor\n" * 9000
ROWS = [(1, "one two three four five six seven eight nine ten eleven"), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, "x" * 120_000), (7, "same words here"), (7, "same words here"), (None, "no id at all")]
CLASH = ("row", "t", "w", "h", "o", "at", "lines", "key", "n_words", "kept", "sid", "n", "grp", "host", "day", "g", "pos")


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string")
    return d.withColumns({c: F.lit(c) for c in CLASH})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "same words here"), (2, None), (3, "")], "item_id long, text string")


def test_quality(docs, empty):
    out = {(r.row.doc_id, r.row.text): r for r in quality_rules.judge(docs).collect()}
    assert len(quality_rules.judge(docs).collect()) == len(ROWS)
    assert not out[2, None].kept and out[2, None].n_words == 0 and out[3, ""].base_failed
    assert out[1, ROWS[0][1]].kept and not out[5, LONG].kept
    kept = quality_rules.filter_quality(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]
    assert quality_rules.filter_quality(empty).count() == 0


def test_decontamination(docs, empty, bench):
    out = decontamination.decontaminate(docs, bench).collect()
    assert len(out) == len(ROWS)
    assert sorted(r.row.doc_id for r in out if r.contaminated) == [7, 7]
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 2
    assert decontamination.decontaminate(empty, bench).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_secrets(docs, empty):
    out = secret_scan.scan(docs).collect()
    assert len(out) == len(ROWS) and all(r.base == [] for r in out)
    same = secret_scan.redact(docs)
    assert same.columns == docs.columns and sorted(map(str, same.collect())) == sorted(map(str, docs.collect()))
    assert secret_scan.redact(empty).count() == 0


def test_pii_and_toxicity(docs, empty, spark):
    out = pii.scan(docs, pii.trained()).collect()
    assert len(out) == len(ROWS) and {r.spans for r in out} == {""}
    assert pii.scan(empty, pii.trained()).count() == 0
    labels = spark.createDataFrame([(1, 0), (7, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out)
    assert all(r.score == out[0].score or r.score >= 0 for r in out)
    assert toxicity.score(docs, toxicity.train(docs, labels.limit(0))).where("predicted = 1").count() == 0
    assert toxicity.score(empty, toxicity.Model({})).count() == 0


def test_packing(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = packing.pack(docs, path).toPandas()
    assert (out["length"] <= packing.SIZE).all() and (out.groupby("sequence_id")["length"].sum() <= packing.SIZE).all()
    assert out[out.doc_id.isin([2, 3])][["length", "doc_tokens"]].values.tolist() == [[1, 1], [1, 1]]
    assert len(out[out.doc_id == 7]) == 2 and out.doc_id.isna().sum() == 1
    assert packing.pack(empty, path).count() == 0


def test_token_output(docs, empty, spark):
    for d, n in ((docs, len(ROWS)), (empty, 0)):
        path = shared_dir(spark)
        token_output.write(d, path, public_tokenizers.path("word_bpe_49k.json"))
        out = token_output.read(spark, path).toPandas().sort_values("start")
        assert len(out) == n
        if n:
            assert (out["start"].values[1:] == out["n_tokens"].cumsum().values[:-1]).all()
            assert out.doc_id.isna().values[0] and out.doc_id.dropna().is_monotonic_increasing


def test_lm(docs, empty):
    out = lm_scoring.score(docs).collect()
    assert len(out) == len(ROWS) and all(r.score < 0 for r in out)
    assert {r.n_tokens for r in out if r.doc_id in (2, 3, 4)} == {1}
    assert lm_scoring.score(empty).count() == 0
    assert lm_scoring.score(docs, F.lit(False)).where("train_tokens <> 0 OR n_known <> 0").count() == 0


def test_jaccard(docs, empty):
    out = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()}
    assert {(2, 0, 2), (3, 0, 3), (4, 0, 4), (7, 1, 7), (None, 1, None)} <= out
    assert jaccard_join.near_duplicates(docs).count() == len(ROWS)
    kept = jaccard_join.keep_first(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 7").count() == 1 and kept.where("doc_id IS NULL").count() == 1
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_urls(spark):
    captures = spark.createDataFrame(
        [(1, "https://a.b.example.com/x", "2024-02-01"), (1, "https://a.b.example.com/x", "2024-02-01"), (2, None, "2024-02-01"), (3, "not a url", None), (4, "http://example.com", None), (5, "http://EXAMPLE.com:80/", "2024-03-01")],
        "page_id long, url string, fetch_day string",
    ).withColumns({"fetch_day": F.col("fetch_day").cast("date"), "host": F.lit(1), "pattern": F.lit(2), "row": F.lit(3)})
    events = spark.createDataFrame(
        [("example.com", "2024-01-01", "add"), ("example.com", "2024-02-15", "remove"), ("b.example.com", "2024-01-10", "add"), (None, "2024-01-01", "add"), ("x", None, "add"), ("tie", "2024-01-01", "add"), ("tie", "2024-01-01", "remove")],
        "pattern string, day string, action string",
    ).withColumn("day", F.col("day").cast("date"))
    out = [(r.row.page_id, r.pattern, r.n_entries, r.blocked) for r in url_filter.filter_urls(captures, events).collect()]
    assert sorted(out) == [(1, "b.example.com", 2, True)] * 2 + [(2, None, 0, False), (3, None, 0, False), (4, None, 0, False), (5, None, 0, False)]
    assert url_filter.filter_urls(captures.limit(0), events).count() == 0
    assert url_filter.filter_urls(captures, events.limit(0)).where("blocked").count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Every stage on nulls, empty and long texts, repeated rows and extra columns, and on an empty table."""
    import corpus_pipeline

    words = "one two three four five six seven eight nine ten eleven twelve".split()
    more = [(20 + i, " ".join(f"{w}{'' if j % 7 else i}" for j, w in enumerate(words * 2))) for i in range(5)] + [(None, " ".join(w + "x" for w in words)), (30, "token=Abc123xyz9 " + " ".join(w + "y" for w in words))]
    docs = spark.createDataFrame(ROWS + more, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long"), "row": F.lit(1), "k0": F.lit("x"), "comp": F.lit(2)})
    spark.createDataFrame([(1, " ".join(w + "0" if j % 7 == 0 else w for j, w in enumerate(words * 2))), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for d in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            d = stage(spark, d, str(tmp_path))
            assert d.columns == docs.columns, name
        kept = {(r.doc_id, r.text) for r in d.collect()}
        out = corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path)).collect()
        assert len({r.doc_id for r in out}) == len({i for i, _ in kept})
        if kept:
            ids = [i for i, _ in kept]
            assert 1 in ids and None in ids and 20 not in ids and not {2, 3, 4, 5} & set(ids)
            assert any(i == 30 and "[SECRET]" in t for i, t in kept)


def test_padding_is_little(spark):
    """Full sequences but for the last of each group."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"), path).toPandas()
    assert out["length"].sum() / (out.sequence_id.nunique() * packing.SIZE) > 0.99
