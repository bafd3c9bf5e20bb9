"""Connected components by alternating large-star and small-star steps.

Every step is a group-by-minimum with partial sums and a join, on the edges
only; a hub with many neighbours is never gathered.  Each round is written to
the shared folder, so a lost executor costs a round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from privlake.llm.common import stored

ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _round(edges: DataFrame) -> DataFrame:
    """edges (u, v), u > v: large star, then small star."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _least(both).select("u", F.least("u", "m").alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    low = _least(large)
    small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return small.where("u <> v").distinct()


def components(edges: DataFrame, path: str) -> DataFrame:
    """(u, root) for every vertex of ``edges`` (u, v: long); ``root`` is the component's least vertex."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e, last = stored(e, f"{path}/0"), None
    for k in range(1, ROUNDS):
        e = stored(_round(e), f"{path}/{k}")
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == last:
            break
        last = tuple(mark)
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct()
    return e.select("u", F.col("v").alias("root")).unionByName(roots)
