"""Access decisions: deny by default, role by sensitivity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from privlake.schema import LEVELS

MATRIX = "role string, niveau string, action string, rang int"


def decide(requests: DataFrame, documents: DataFrame, matrix: DataFrame) -> DataFrame:
    """Requests (role, document_id, ...) with ``code``, ``action`` and ``motif``.

    404 unknown document; 423 not analysed, or without a level; 403 refused; 200 else.  The matrix is a
    fixed 24 cells and is broadcast; documents join by id.  A missing cell refuses.
    """
    docs = documents.select(F.col("id").alias("document_id"), "statut", "niveau_max", F.lit(True).alias("_known"))
    cells = matrix.select("role", F.col("niveau").alias("niveau_max"), "action")
    d = requests.join(docs, "document_id", "left").join(F.broadcast(cells), ["role", "niveau_max"], "left")
    unknown, locked = F.col("_known").isNull(), (F.col("statut") != "analyse") | F.col("niveau_max").isNull() | ~F.col("niveau_max").isin(*LEVELS)
    action = F.coalesce("action", F.lit("refus"))
    return d.select(
        *requests.columns, "niveau_max",
        F.when(unknown, 404).when(locked, 423).when(action == "refus", 403).otherwise(200).alias("code"),
        F.when(~unknown & ~locked, action).alias("action"),
        F.when(unknown, "document_inconnu").when(locked, "document_non_analyse").when(action == "refus", "politique_refus").alias("motif"),
    )


def listing(matrix: DataFrame) -> DataFrame:
    """The matrix in order of role and rank."""
    return matrix.orderBy("role", "rang").select("role", "niveau", "action")


def audit_rows(decided: DataFrame) -> DataFrame:
    """One audit row for each outcome; ``details`` says why."""
    return decided.select(
        F.col("role").alias("role_effectif"), "document_id", F.when(F.col("code") == 200, "LECTURE").otherwise("REFUS").alias("action"),
        F.col("action").alias("politique_appliquee"), F.col("niveau_max").alias("niveau_en_cause"),
        F.to_json(F.struct("motif", "code")).alias("details"),
    )


def roles(matrix: DataFrame) -> DataFrame:
    """The roles that the matrix knows."""
    return matrix.select("role").distinct().orderBy("role")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The stored matrix; one that isn't there is empty, which refuses everything.  Read again for each batch of requests."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], MATRIX)
    return spark.read.schema(MATRIX).parquet(path)


def metadata_rows(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """One audit row for each request (role, document_id) to see a document's metadata, which any role may: a reading
    without policy; an unknown document is refused."""
    d = requests.join(documents.select(F.col("id").alias("document_id"), "niveau_max", F.lit(True).alias("_known")), "document_id", "left")
    known = F.col("_known").isNotNull()
    return d.select(
        F.col("role").alias("role_effectif"), "document_id", F.when(known, "LECTURE").otherwise("REFUS").alias("action"), F.lit(None).cast("string").alias("politique_appliquee"),
        F.col("niveau_max").alias("niveau_en_cause"), F.to_json(F.struct(F.when(known, "metadonnees").otherwise("document_inconnu").alias("motif"))).alias("details"),
    )
