"""Joins of tables of intervals that overlap, without comparing all pairs of a key.

An interval has a level by its length: ``WIDTH`` at level 0, ``FAN`` times more at each next.
At its own level it lies in a few bins (``FAN`` + 1 at most).  Two intervals meet at the level of the longer
one: the longer by the bins of its level, the shorter by those few it has there too.  So a page-long
interval isn't cut into thousands of small bins, and short ones don't meet in large bins unless a
long one is there.  A pair meets in several bins but is told in one: that of the greater start.

The keys are (key, level, bin): a document with a third of all intervals is spread over its bins.  Where
many intervals lie on one spot all their pairs are results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

WIDTH, FAN, LEVELS = 64, 16, 6


def _level(a: Column, b: Column) -> Column:
    """Lowest level whose bins are at least as wide as the interval; the last one takes the rest."""
    wide = lambda k: WIDTH * FAN**k
    return reduce(lambda rest, k: F.when(b - a <= wide(k), k).otherwise(rest), reversed(range(LEVELS - 1)), F.lit(LEVELS - 1))


def _bin(x: Column, level: Column) -> Column:
    return F.floor(x / F.element_at(F.array(*[F.lit(WIDTH * FAN**k).cast("long") for k in range(LEVELS)]), level + 1))


def _levels(df: DataFrame, a: str, b: str) -> list[int]:
    """The levels that intervals of ``df`` have: ``LEVELS`` numbers at most."""
    d = df.select(F.col(a).cast("long").alias("_a"), F.col(b).cast("long").alias("_b")).where("_a <= _b")
    return sorted(r[0] for r in d.select(_level(F.col("_a"), F.col("_b"))).distinct().collect())


def _placed(df: DataFrame, side: str, keys: list[str], a: str, b: str, others: list[int] | None = None) -> DataFrame:
    """Rows (keys, niveau, seau, side) at an interval's own level, or at those of ``others`` above it."""
    d = df.select(*keys, F.struct("*").alias(side), F.col(a).cast("long").alias("_a"), F.col(b).cast("long").alias("_b")).where("_a <= _b")
    level = _level(F.col("_a"), F.col("_b"))
    if others is None:
        d = d.withColumn("niveau", level)
    else:
        d = d.withColumn("niveau", F.explode(F.filter(F.array(*map(F.lit, others)), lambda k: k > level)))
    last = F.greatest("_a", F.col("_b") - 1)
    bins = F.sequence(_bin(F.col("_a"), F.col("niveau")), _bin(last, F.col("niveau")))
    return d.withColumn("seau", F.explode(bins)).withColumnRenamed("_a", f"{side}_a").withColumnRenamed("_b", f"{side}_b")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], start: str = "debut", end: str = "fin") -> DataFrame:
    """(gauche, droite): structs of the rows of each side that have equal ``keys`` and overlap, each pair once.

    [a, b) and [c, d) overlap if a < d and c < b, so an empty interval inside another one does.  Rows with a null key or
    limit, or that end before they start, meet nothing.
    """
    on = [*keys, "niveau", "seau"]
    l0, r0 = _placed(left, "gauche", keys, start, end), _placed(right, "droite", keys, start, end)
    d = l0.join(r0, on)
    # the shorter goes to the levels only that longer ones of the other side have
    of_left, of_right = _levels(left, start, end), _levels(right, start, end)
    if of_left and of_right and of_left[-1] > of_right[0]:
        d = d.unionByName(l0.join(_placed(right, "droite", keys, start, end, of_left), on))
    if of_left and of_right and of_right[-1] > of_left[0]:
        d = d.unionByName(_placed(left, "gauche", keys, start, end, of_right).join(r0, on))
    hit = (F.col("gauche_a") < F.col("droite_b")) & (F.col("droite_a") < F.col("gauche_b"))
    told = _bin(F.greatest("gauche_a", "droite_a"), F.col("niveau")) == F.col("seau")
    return d.where(hit & told).select("gauche", "droite")
