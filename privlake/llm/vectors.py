"""Vectors of whole numbers, shared by the operators on ``embeddings``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Quantised components are exact, and so are their squares' sums, while they stay below it.
LARGEST = 1 << 40


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds no null and no entry that isn't finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad), F.lit(False))


def quantised(vector: Column, shift: int = 0) -> Column:
    """``floor(64 * x) + shift`` of each component as a long, x as double; components of 2^40 or more are an error."""

    def one(x: Column) -> Column:
        y = F.floor(x.cast("double") * 64.0)
        return F.when(F.abs(x) < LARGEST / 64, y + shift).otherwise(F.raise_error(F.lit("a component is too large to quantise")).cast("long"))

    return F.transform(vector, one)


def matrix(column, width: int):
    """The rows of an Arrow column of lists of one length, as a numpy matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
