"""Exact order statistics of groups of any size, without gathering a group.

Values are counted first (equal ones are summed before the shuffle), the counted values
are range-partitioned by (group, value), and each range counts its values of each
group.  Those counts (a row a range and group) give every range the number of values before
it, so a value knows its places in its group and one join picks those asked for.  No task
sees a whole group, and skewed groups are cut by value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from privlake.operators.catalog import materialise


def order_statistics(df: DataFrame, by: str, col: str, wanted: dict[str, Column]) -> DataFrame:
    """(by, n, one column for each name): the values at the given places (from 0) of each group's sorted values.

    A place is a column of ``n``, the group's number of values; nulls don't count, and a place beyond the end is null.
    """
    counted = df.where(F.col(col).isNotNull()).groupBy(by, col).agg(F.count(F.lit(1)).alias("_c"))
    d = materialise(counted.repartitionByRange(by, col).withColumn("_p", F.spark_partition_id()))
    sizes = d.groupBy("_p", by).agg(F.sum("_c").alias("_s"))  # a row a range and group
    w = Window.partitionBy(by).orderBy("_p")
    before = sizes.select("_p", F.col(by).alias("_by"), (F.sum("_s").over(w) - F.col("_s")).alias("_before"), F.sum("_s").over(Window.partitionBy(by)).alias("n"))
    d = d.join(before, (d["_p"] == before["_p"]) & d[by].eqNullSafe(before["_by"])).drop(before["_p"])
    end = F.col("_before") + F.sum("_c").over(Window.partitionBy("_p", by).orderBy(col).rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_end", end)
    at = lambda place: (place >= F.col("_end") - F.col("_c")) & (place < F.col("_end"))
    picked = [F.max(F.when(at(place), F.col(col))).alias(name) for name, place in wanted.items()]
    return d.groupBy(by).agg(F.max("n").alias("n"), *picked)
