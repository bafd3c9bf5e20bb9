"""Benchmark decontamination: broadcast hash set of normalised test n-grams.

The benchmark's token windows become a small table keyed by a 64-bit hash of
their first words; every place of a document is looked up in it by a broadcast
hash join, each hash hit is verified word by word over the whole window, and
only verified hits are grouped (by document).

The broadcast is used only while the benchmark has at most ``BROADCAST_WINDOWS``
windows (counted before the join).  For a larger one only places travel, each a
key and a hash: they meet the distinct hashes first, and the few that are left go
back to their texts, as a list for each document, to be verified.  A filter sends
the ids of what it drops only.

Edge cases: null or empty text has no words, no hit and isn't contaminated; an
item without words has no window; items with the same words all count; repeated
rows get the same verdict each (rows are matched by id and text); null ids are
kept; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from privlake.llm.common import ascii_lower, split_words, stored, table

N = 13
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same without lower-casing first, where only the number of words matters.
ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Windows are looked up by the hash of their first words, then compared whole.
ANCHOR = 5
#: A window holds 13 words and its items, about 200 bytes: 50 MB at most.
BROADCAST_WINDOWS = 250_000
#: Ids (with a hash and a length) of contaminated documents that a filter broadcasts, 30 MB at most.
BROADCAST_IDS = 1_000_000


def _words(df: DataFrame, *keep: Column) -> DataFrame:
    return df.select(*keep, split_words(ascii_lower(F.col("text")), SEPARATORS).alias("w"))


def _hash(at: Column, k: int) -> Column:
    """Hash of the ``k`` words from place ``at``."""
    return F.xxhash64(*[F.get(F.col("w"), at + i) for i in range(k)])


def _hash_of(k: int):
    return lambda at: _hash(at, k)


def benchmark_windows(bench: DataFrame, n: int = N) -> DataFrame:
    """Distinct windows (k, g, gram, items): ``g`` hashes the first ``k`` words, at most ANCHOR; ``items``
    are the ids, as text, that have the window."""
    b = _words(bench, F.col("item_id").cast("string").alias("item_id")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))
    rows = b.select("item_id", F.explode(grams).alias("w")).groupBy("w").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    g = F.lit(None).cast("long")
    for k in range(1, ANCHOR + 1):
        g = F.when(F.size("w") >= k, _hash(F.lit(0), k)).otherwise(g)
    return rows.select(F.least(F.size("w"), F.lit(ANCHOR)).alias("k"), g.alias("g"), F.col("w").alias("gram"), "items")


def _anchors(bench: DataFrame, n: int) -> tuple[list[int], int]:
    """The anchor lengths that occur (ANCHOR values at most) and the number of windows, repeated ones counted each."""
    words = F.size(split_words(ascii_lower(F.col("text")), SEPARATORS))
    d = bench.select(F.least(words, F.lit(ANCHOR)).alias("k"), F.when(words > 0, F.greatest(words - n + 1, F.lit(1))).otherwise(0).alias("c"))
    rows = d.groupBy("k").agg(F.sum("c").alias("c")).collect()
    return sorted(r.k for r in rows if r.k > 0), sum(r.c for r in rows)


def _places(d: DataFrame, names: list[str], lengths: list[int], *more: str) -> DataFrame:
    """(names, more, k, pos, g): the hash of ``k`` words at every place of each text ``w``."""
    found = None
    for k in lengths:
        places = F.transform(F.sequence(F.lit(0), F.size("w") - k), _hash_of(k))
        one = d.where(F.size("w") >= k).select(*names, *more, F.lit(k).alias("k"), F.posexplode(places).alias("pos", "g"))
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = d.select(*names, *more, F.lit(0).alias("k"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("g")).where("false")
    return found


def _likely(d: DataFrame, grams: DataFrame, names: list[str], lengths: list[int]) -> DataFrame:
    """(names, w, k, pos, g) of the places whose hash the benchmark has: keys and hashes are shuffled by hash, and the texts
    once, by key, to what is left of their places."""
    places = _places(d, names, lengths).join(grams.select("k", "g").distinct(), ["k", "g"], "left_semi")
    mine = places.groupBy(*names).agg(F.collect_set(F.struct("k", "pos", "g")).alias("found")).select(*[F.col(c).alias(f"m_{c}") for c in names], "found")
    on = [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in names]
    return d.join(mine, on).select(*names, "w", F.explode("found").alias("x")).select(*names, "w", "x.*")


def hits(docs: DataFrame, bench: DataFrame, key: list[Column], n: int = N, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per key with a hit: ``n_words`` of the text, ``n_hit`` covered words and the sorted ``items``."""
    lengths, windows = _anchors(bench, n)
    grams = benchmark_windows(bench, n)
    names = [f"k{i}" for i in range(len(key))]
    d = _words(docs, *[c.alias(x) for c, x in zip(key, names, strict=True)])
    if windows <= broadcast_windows:
        grams = F.broadcast(grams)
        found = _places(d, names, lengths, "w")
    else:
        found = _likely(d, grams, names, lengths).withColumns({"piece": F.slice("w", F.col("pos") + 1, n), "n_words": F.size("w")}).drop("w")
    whole = windows <= broadcast_windows
    size = F.size("gram")
    same = F.slice(F.col("w"), F.col("pos") + 1, size) == F.col("gram") if whole else F.slice("piece", 1, size) == F.col("gram")
    words = F.size("w").alias("n_words") if whole else F.col("n_words")
    found = found.join(grams, ["k", "g"]).where(same).select(*names, words, "pos", size.alias("len"), "items")
    # the longest window from each position covers what the others do
    spans = found.groupBy(*names, "n_words", "pos").agg(F.max("len").alias("len"), F.flatten(F.collect_set("items")).alias("items"))
    per = spans.groupBy(*names, "n_words").agg(
        F.sort_array(F.collect_list(F.struct("pos", (F.col("pos") + F.col("len")).alias("end")))).alias("s"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.array_distinct("items"))))).alias("items"),
    )
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    step = lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["to"], x["pos"]))).alias("n"), F.greatest(a["to"], x["end"]).alias("to")
    )
    return per.select(*names, F.col("n_words").cast("long").alias("n_words"), F.aggregate("s", state, step)["n"].cast("long").alias("n_hit"), "items")


def _key(id_col: str) -> list[Column]:
    return [F.col(id_col), F.xxhash64("text"), F.length("text")]


def _bad(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", keep: list[str] | None = None, n: int = N) -> DataFrame:
    """``row`` (the document's columns, or those in ``keep``), n_words, n_hit, items and ``contaminated``.

    ``docs`` has the columns ``id_col`` and ``text``.  What is kept travels in
    the join with the hits: leave the text out where it isn't needed.
    """
    keep = docs.columns if keep is None else keep
    key = _key(id_col)
    found = hits(docs, bench, key, n).drop("n_words")
    n_words = F.size(split_words(F.col("text"), ANY_CASE)).cast("long")
    d = docs.select(F.struct(*keep).alias("row"), n_words.alias("n_words"), *[c.alias(f"d{i}") for i, c in enumerate(key)])
    on = [F.col(f"d{i}").eqNullSafe(F.col(f"k{i}")) for i in range(len(key))]
    d = d.join(found, on, "left").select(
        "row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
    return d.withColumn("contaminated", _bad(F.col("n_hit"), F.col("n_words")))


def drop_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that aren't contaminated, with their columns."""
    key = _key(id_col)
    names = [f"k{i}" for i in range(len(key))]
    bad = stored(hits(docs, bench, key).where(_bad(F.col("n_hit"), F.col("n_words"))).select(*names))
    few = bad.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    d = docs.select(F.struct("*").alias("row"), *[c.alias(f"d{i}") for i, c in enumerate(key)])
    on = [F.col(f"d{i}").eqNullSafe(F.col(f"k{i}")) for i in range(len(key))]
    d = d.join(F.broadcast(bad) if few else bad, on, "left_anti")
    return d.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), keep=["doc_id"])
    return d.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 13) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bl)),
ks AS (SELECT DISTINCT k FROM bl),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT dw.doc_id, dw.i, bw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::varchar AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""
