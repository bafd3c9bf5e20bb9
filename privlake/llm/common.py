"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ASCII white space as the contracts define it: space, \t, \n, \v, \f, \r.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    The folder is the one the session names in ``spark.checkpoint.dir``; where
    that is unset in local mode (tests) the warehouse folder stands in for it; a
    cluster without it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/privlake-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage and
    survives the loss of executors.  ``codec``: Parquet's, else the session's."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    out = df.write.mode("overwrite")
    (out.option("compression", codec) if codec else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, Python workers get batches of so many rows: for columns of kilobytes a row.  Restored afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, was)


#: What operators keep in a Python worker between tasks; Spark reuses workers for other stages.
_KEPT: list[dict] = []


def kept(cache: dict) -> dict:
    _KEPT.append(cache)
    return cache


def drop_kept(but: dict | None = None) -> None:
    """Free what other operators and earlier tasks have left in this worker, and give it back to the machine."""
    import ctypes

    import pyarrow as pa

    for cache in _KEPT:
        if cache is not but:
            cache.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library than glibc


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column, separator: str) -> Column:
    """The non-empty pieces between matches of ``separator``; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separator, -1), "")


def crc32_mod(col: Column, n: int) -> Column:
    """crc32 of the value's decimal text, modulo ``n``; a null id counts as ''."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n
