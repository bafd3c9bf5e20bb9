"""The catalogue: snapshots of sources, documents and detected entities.

Plain Parquet has no update: every change is a new snapshot, computed by joins
from the old one and written to a new folder by ``publish``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from privlake.schema import SOURCE, SOURCE_TYPES, STATUSES

RETRIES, RETRY_BATCH = 3, 200
#: Seconds before an analysis is tried again, doubled at each try.
BACKOFF = 5
DEFAULT_CRON = "0 2 * * *"
QUEUE = "document_id string, essais int, pret_le timestamp"


def all_of(tests: dict[str, object]) -> Column:
    """Conjunction of equalities; filters without a value are left out."""
    return reduce(lambda a, b: a & b, [F.col(c) == F.lit(x) for c, x in tests.items() if x is not None], F.lit(True))


def sources(df: DataFrame, active_only: bool = False) -> DataFrame:
    return (df.where("actif") if active_only else df).orderBy("libelle", "id")


def documents_page(df: DataFrame, page: int = 1, size: int = 50, **tests) -> DataFrame:
    """A page, latest discovery first (ties by id); size 1 to 500."""
    size = max(1, min(500, size))
    return df.where(all_of(tests)).orderBy(F.desc("date_decouverte"), "id").offset((max(1, page) - 1) * size).limit(size)


def listing(documents: DataFrame) -> DataFrame:
    """What a listing shows of documents; a size that isn't known stays null."""
    return documents.select("id", "source_id", F.col("chemin_source").alias("chemin"), "type_mime", F.col("taille_octets").alias("taille"), "statut", F.col("niveau_max").alias("niveau"), "tentatives")


def account(users: DataFrame, name: str) -> DataFrame:
    """The active account of a name, with the role it has now."""
    return users.where((F.col("identifiant") == name) & F.col("actif")).select("identifiant", "role_code")


def located(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Where each document's bytes are: its key with the type and configuration of its source; ``connu`` is false if the source isn't known."""
    s = sources.select(F.col("id").alias("source_id"), F.col("type").alias("type_source"), "configuration", F.lit(True).alias("connu"))
    d = documents.select("id", "source_id", F.col("chemin_source").alias("cle")).join(s, "source_id", "left")
    return d.withColumn("connu", F.coalesce("connu", F.lit(False)))


def page_count(total: Column, size: int = 50) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / size)).cast("int")


def upsert_documents(snapshot: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, changed rows).

    ``listed`` (id, source_id, chemin_source, empreinte_sha256, type_mime, taille_octets, vu_le) has one row for each
    place.  A new place is inserted; a known one with another hash is reset to 'decouvert' and keeps its id and
    date of discovery; the rest, and places that aren't listed, stay as they are.
    """
    keys = ["source_id", "chemin_source"]
    new = listed.select(*keys, *[F.col(c).alias(f"n_{c}") for c in listed.columns if c not in keys])
    d = snapshot.join(new, keys, "full")
    fresh, differs = F.col("id").isNull(), F.col("id").isNotNull() & F.col("n_id").isNotNull() & ~F.col("empreinte_sha256").eqNullSafe(F.col("n_empreinte_sha256"))
    changed = fresh | differs
    take = lambda c: F.when(changed, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    reset = lambda c, x: F.when(changed, F.lit(x)).otherwise(F.col(c)).cast(dict(snapshot.dtypes)[c]).alias(c)
    out = d.select(
        F.coalesce("id", "n_id").alias("id"), *keys, take("empreinte_sha256"), take("type_mime"), take("taille_octets"), reset("statut", "decouvert"),
        reset("niveau_max", None), F.coalesce("date_decouverte", "n_vu_le").alias("date_decouverte"), reset("date_analyse", None), reset("tentatives", 0),
        reset("motif_echec", None), changed.alias("_changed"),
    )
    return out.drop("_changed").select(*snapshot.columns), out.where("_changed").drop("_changed").select(*snapshot.columns)


def create_source(spark: SparkSession, table: DataFrame, kind: str, label: str, configuration: dict, cron: str = DEFAULT_CRON) -> DataFrame:
    """``table`` with a new active source; its type must be known, its label not empty, its configuration a mapping."""
    import json

    if kind not in SOURCE_TYPES or not isinstance(label, str) or not label.strip() or not isinstance(configuration, dict):
        raise ValueError("a source has a known type, a label and a configuration")
    row = (str(uuid.uuid4()), kind, label, json.dumps(configuration, sort_keys=True), cron, None, True)
    return table.unionByName(spark.createDataFrame([row], SOURCE))


def enqueue(queue: DataFrame, documents: DataFrame, now) -> DataFrame:
    """``queue`` (document_id, essais, pret_le) with the ``documents`` (id) that aren't in it: one task a document."""
    fresh = documents.select(F.col("id").alias("document_id")).distinct().join(queue.select("document_id"), "document_id", "left_anti")
    return queue.unionByName(fresh.select("document_id", F.lit(0).alias("essais"), F.lit(now).cast("timestamp").alias("pret_le")))


def start_analyses(snapshot: DataFrame, queue: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(snapshot, tasks): the tasks that are due, and their documents marked 'en_analyse'."""
    due = queue.where(F.col("pret_le") <= F.lit(now).cast("timestamp"))
    return update_status(snapshot, due.select(F.col("document_id").alias("id"), F.lit("en_analyse").alias("statut"), F.lit(None).cast("string").alias("motif"))), due


def finish_analyses(queue: DataFrame, outcomes: DataFrame, now) -> DataFrame:
    """``queue`` after ``outcomes`` (document_id, reussi): what succeeded, or failed for the third time, leaves it; other
    failures wait BACKOFF seconds, doubled at each try."""
    # reports of one document are one: a success counts before failures
    outcomes = outcomes.groupBy("document_id").agg(F.max("reussi").alias("reussi"))
    d = queue.join(outcomes, "document_id", "left")
    tries = F.col("essais") + F.col("reussi").isNotNull().cast("int")
    wait = F.make_interval(secs=F.lit(BACKOFF) * F.pow(F.lit(2), tries - 1))
    due = F.when(F.col("reussi").isNull(), F.col("pret_le")).otherwise(F.lit(now).cast("timestamp") + wait)
    return d.where("reussi IS NULL OR NOT reussi").select("document_id", tries.alias("essais"), due.alias("pret_le")).where(F.col("essais") < RETRIES)


def one_of_each(updates: DataFrame, key: str, order: Column) -> DataFrame:
    """One row of each key, the greatest by ``order``: a snapshot's row meets one update at most."""
    last = updates.groupBy(key).agg(F.max_by(F.struct("*"), order).alias("_x"))
    return last.select(*[F.col("_x").getField(c).alias(c) for c in updates.columns])


def update_status(snapshot: DataFrame, updates: DataFrame) -> DataFrame:
    """``updates`` (id, statut, motif): attempts count on failures, the reason is overwritten (500 characters), the level stays.

    Several updates of a document in one call are one: the furthest status, the greatest reason among equals.
    """
    far = F.struct(F.array_position(F.array(*map(F.lit, STATUSES)), F.col("statut")), F.coalesce("motif", F.lit("")))
    updates = one_of_each(updates.select("id", "statut", "motif"), "id", far)
    d = snapshot.join(updates.select("id", F.col("statut").alias("_s"), F.col("motif").alias("_m"), F.lit(True).alias("_u")), "id", "left")
    u = F.col("_u").isNotNull()
    return d.withColumns({
        "tentatives": F.when(u & (F.col("_s") == "echec"), F.col("tentatives") + 1).otherwise(F.col("tentatives")).cast("smallint"),
        "motif_echec": F.when(u, F.substring("_m", 1, 500)).otherwise(F.col("motif_echec")), "statut": F.when(u, F.col("_s")).otherwise(F.col("statut")),
    }).select(*snapshot.columns)


def replace_entities(entities: DataFrame, documents: DataFrame, fresh: DataFrame, analysed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, documents) after analysis: the entities of the ``analysed`` documents (id, niveau_max, date_analyse) are replaced
    by ``fresh``, and the documents marked.  Of several analyses of a document the latest counts."""
    analysed = one_of_each(analysed.select("id", "niveau_max", "date_analyse"), "id", F.struct("date_analyse", F.coalesce("niveau_max", F.lit(""))))
    ids = analysed.select(F.col("id").alias("document_id"))
    kept = entities.join(ids, "document_id", "left_anti").select(*entities.columns).unionByName(fresh.select(*entities.columns))
    a = analysed.select("id", F.col("niveau_max").alias("_n"), F.col("date_analyse").alias("_d"), F.lit(True).alias("_a"))
    d = documents.join(a, "id", "left")
    done = F.col("_a").isNotNull()
    d = d.withColumns({
        "statut": F.when(done, "analyse").otherwise(F.col("statut")), "niveau_max": F.when(done, F.col("_n")).otherwise(F.col("niveau_max")),
        "date_analyse": F.when(done, F.col("_d")).otherwise(F.col("date_analyse")), "motif_echec": F.when(done, F.lit(None)).otherwise(F.col("motif_echec")),
    })
    return kept, d.select(*documents.columns)


def insert_missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Append rows whose key isn't there yet (one of each key)."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti").select(*table.columns))


def to_retry(documents: DataFrame, source_id: str | None = None, batch: int = RETRY_BATCH) -> DataFrame:
    """Documents to analyse again, oldest first; a failed one up to three times."""
    d = documents.where((F.col("statut") != "analyse") & ((F.col("statut") != "echec") | (F.col("tentatives") < RETRIES)))
    return d.where(all_of({"source_id": source_id})).orderBy("date_decouverte", "id").limit(batch)


def entity_metadata(entities: DataFrame, document_id: str) -> DataFrame:
    """Types, levels and pages of a document's entities in order of position; never a value or its hash."""
    d = entities.where(F.col("document_id") == document_id).orderBy("position_debut", "position_fin", "type_entite")
    return d.select("type_entite", "niveau_sensibilite", "page")


def scan_run(source_id: str, outcome: DataFrame, trigger: str, started, ended) -> DataFrame:
    """One row of counters from a resource outcome column (nouveau, inchange, echec)."""
    n = lambda x: F.count_if(F.col("resultat") == x).cast("int")
    return outcome.agg(
        F.lit(source_id).alias("source_id"), F.lit(started).cast("timestamp").alias("demarre_le"), F.lit(ended).cast("timestamp").alias("termine_le"),
        F.count(F.lit(1)).cast("int").alias("nb_listes"), n("nouveau").alias("nb_nouveaux"), n("inchange").alias("nb_inchanges"), n("echec").alias("nb_echecs"),
        F.lit(trigger).alias("declencheur"),
    )


def schedule_changes(running: DataFrame, active: DataFrame) -> DataFrame:
    """(id, change): sources to stop and to start after a reload."""
    stop = running.join(active, "id", "left_anti").select("id", F.lit("arreter").alias("change"))
    return stop.unionByName(active.join(running, "id", "left_anti").select("id", F.lit("demarrer").alias("change")))


def shared_path(spark: SparkSession) -> str:
    """A new folder's name below the shared folder (``spark.checkpoint.dir``, else, in local mode, the warehouse)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/privlake-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written once below the shared folder and read again, where several steps need it: an analysis isn't repeated,
    and a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The column that a bucketed catalogue is partitioned by.
BUCKET = "seau"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def create_bucketed(snapshot: DataFrame, path: str, key: str, buckets: int) -> None:
    """Write ``snapshot`` as ``buckets`` partitions by a hash of ``key``, one file each."""
    d = snapshot.withColumn(BUCKET, bucket_of(F.col(key), buckets))
    d.repartition(buckets, BUCKET).write.partitionBy(BUCKET).parquet(path)


def bucketed(spark: SparkSession, path: str, schema) -> DataFrame:
    """A bucketed catalogue, with the column BUCKET; a filter on it reads the buckets it names alone."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(path)


def change_bucketed(spark: SparkSession, path: str, schema, key: str, buckets: int, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """Apply ``changes`` (rows with ``key``) to a bucketed catalogue; returns the buckets that were read and written.

    The touched buckets (numbers only, at most ``buckets``) prune the read; ``apply(rows, changes)`` gives their new rows, as on a whole
    snapshot, and dynamic overwrite replaces those partitions when the job commits: a job that fails leaves all as it was.
    The new rows are written once before, as a bucket can't be read while it is replaced.  One writer at a time.
    """
    changes = materialise(changes.withColumn(BUCKET, bucket_of(F.col(key), buckets)))
    touched = sorted(r[0] for r in changes.select(BUCKET).distinct().collect())  # numbers of buckets
    if not touched:
        return []
    old = bucketed(spark, path, schema).where(F.col(BUCKET).isin(touched)).drop(BUCKET)
    new = materialise(apply(old, changes.drop(BUCKET)).select(*[f.name for f in schema.fields]))
    out = new.withColumn(BUCKET, bucket_of(F.col(key), buckets)).repartition(len(touched), BUCKET)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return touched


def publish(df: DataFrame, base: str, version: int) -> str:
    """Write a snapshot to a folder of its own; readers move to it by its name once it is whole."""
    path = f"{base}/v={version:010d}"
    df.write.mode("errorifexists").parquet(path)
    return path
