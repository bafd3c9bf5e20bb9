"""The registry of queries over the test tables, and what they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SALT = "sel-de-test"
TODAY = "2026-01-01"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tasks a core, for tables with little to read and much to do.
TASKS = 4


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt over all cores by ``key``: hundreds of thousands of short rows lie in a file of a few MB, which one task reads."""
    return df.repartition(TASKS * df.sparkSession.sparkContext.defaultParallelism, key)


def today() -> Column:
    return F.lit(TODAY).cast("date")
