"""Incremental ingestion: a scan against the snapshot, in batches or as a stream.

The file stream source doesn't report files edited in place, so change
detection is a join on content hashes; a stream only brings the listings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from privlake.operators.catalog import upsert_documents
from privlake.sources.files import content_type


def listed_documents(resources: DataFrame, seen_at) -> DataFrame:
    """Rows for ``upsert_documents`` from listed resources (with source_id): hash of the bytes, effective type."""
    return resources.select(
        F.sha2(F.concat_ws("|", "source_id", "cle"), 256).alias("id"), "source_id", F.col("cle").alias("chemin_source"),
        F.sha2("content", 256).alias("empreinte_sha256"), content_type(F.col("content"), F.col("type_mime"), F.col("cle")).alias("type_mime"),
        F.col("taille").alias("taille_octets"), F.lit(seen_at).cast("timestamp").alias("vu_le"),
    ).dropDuplicates(["source_id", "chemin_source"])


def scan(snapshot: DataFrame, resources: DataFrame, seen_at) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new snapshot, changed documents, outcome of each resource: nouveau, inchange or echec)."""
    readable = resources.where("content IS NOT NULL")
    listed = listed_documents(readable, seen_at)
    new, changed = upsert_documents(snapshot, listed)
    keys = ["source_id", "chemin_source"]
    fresh = changed.select(*keys, F.lit("nouveau").alias("r"))
    outcome = resources.select("source_id", F.col("cle").alias("chemin_source"), F.col("content").isNull().alias("lost")).join(fresh, keys, "left")
    return new, changed, outcome.select(*keys, F.when(F.col("lost"), "echec").otherwise(F.coalesce("r", F.lit("inchange"))).alias("resultat"))


def stream(listings: DataFrame, load: Callable[[], DataFrame], store: Callable[[DataFrame, DataFrame, DataFrame, int], None], checkpoint: str):
    """A query over a stream of resources: each micro-batch is scanned against the snapshot that ``load`` gives.

    ``store`` gets the new snapshot, the changed documents (to be queued), the outcome of each resource (to be counted) and
    the batch's number; a batch that comes again has its first time and number, and replaces its own.
    """
    timed = listings.withColumn("_vu_le", F.current_timestamp())  # of the batch, kept in the stream's log

    def batch(df: DataFrame, number: int) -> None:
        store(*scan(load(), df, F.col("_vu_le")), number)

    return timed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extension: actions by event-time window, for a batch or a stream with late rows."""
    d = events.withWatermark("ts", late) if events.isStreaming else events
    d = d.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return d.select(F.col("w.start").alias("debut"), "event_type", "n")
