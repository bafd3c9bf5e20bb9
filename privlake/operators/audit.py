"""Hash-chained audit log: append, verify, search.

Verification is parallel: before the first break every stored hash is the one
expected, so each row needs only its predecessor's hash.  Rows are dealt by
blocks of ids (a function of the id, so every use of a row sees it in the same
block); the predecessor comes from within the block, and the first and the last
row of each block bridge the borders.  No task sees more than a block, or one
row for each block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from privlake.functions.validators import card_valid

GENESIS = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # sha256 of nothing
_HASHED = ("utilisateur_id", "role_effectif", "document_id", "action", "politique_appliquee")
#: Ids of a block, which one task verifies in order.
BLOCK = 1 << 16


def iso_time(t: Column) -> Column:
    """Milliseconds, UTC: 2024-01-02T03:04:05.678Z (session time zone UTC)."""
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _hashed_part() -> Column:
    """What of a row its hash covers, after the hash before it; null fields count as empty."""
    return F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in (*map(F.col, _HASHED), iso_time(F.col("horodatage")))])


def link_hash(previous: Column) -> Column:
    """Hash of a row after ``previous``."""
    return F.sha2(F.concat_ws("|", F.coalesce(previous, F.lit("")), _hashed_part()), 256)


_LOG = (
    "id bigint, horodatage timestamp, utilisateur_id string, role_effectif string, document_id string, action string, politique_appliquee string, "
    "niveau_en_cause string, adresse_ip string, details string, empreinte_precedente string, empreinte string"
)
_GIVEN = ["ordre", "horodatage", *_HASHED, "niveau_en_cause", "adresse_ip", "details"]


def append_by(rows: DataFrame, by: str, heads: DataFrame | None = None) -> DataFrame:
    """``rows`` (with ``ordre`` and the shard ``by``) as rows of one chain for each shard, after ``heads`` (by, id, empreinte).

    A hash needs the one before, so a chain is one ordered pass; chains are dealt over the tasks, and a task streams
    its sorted rows, holding one.  Ids count within a shard.
    """
    kind = dict(rows.dtypes)[by]
    head = F.struct(F.lit(0).cast("long").alias("id"), F.lit(None).cast("string").alias("empreinte"))
    d = rows.select(F.col(by).alias("_by"), *_GIVEN)
    if heads is None:
        d = d.withColumn("_head", head)
    else:
        h = heads.select(F.col(by).alias("_h"), F.struct("id", "empreinte").alias("_head"))
        d = d.join(h, F.col("_by").eqNullSafe(F.col("_h")), "left").drop("_h").withColumn("_head", F.coalesce("_head", head))

    def run(batches):
        import hashlib

        import pyarrow as pa

        at = object()
        previous, n = None, 0
        for b in batches:
            ids, before, after = [], [], []
            for shard, head_id, head_hash, rest in zip(*(b[c].to_pylist() for c in ("partie", "head_id", "head_hash", "reste")), strict=True):
                if shard != at:
                    at, previous, n = shard, head_hash, head_id
                before.append(previous)
                previous, n = hashlib.sha256(f"{previous or GENESIS}|{rest}".encode()).hexdigest(), n + 1
                ids.append(n)
                after.append(previous)
            new = {by: b["partie"], "id": pa.array(ids, pa.int64()), "empreinte_precedente": pa.array(before, pa.string()), "empreinte": pa.array(after, pa.string())}
            names = [by, *(c.split()[0] for c in _LOG.split(", "))]
            yield pa.RecordBatch.from_arrays([new[c] if c in new else b[c] for c in names], names)

    d = d.select("_by", *_GIVEN, F.col("_head.id").alias("head_id"), F.col("_head.empreinte").alias("head_hash"), _hashed_part().alias("reste"))
    d = d.repartition("_by").sortWithinPartitions("_by", "ordre").withColumnRenamed("_by", "partie")
    return d.mapInArrow(run, f"`{by}` {kind}, {_LOG}")


def append(rows: DataFrame, last_id: int = 0, last_hash: str | None = None) -> DataFrame:
    """``rows`` (with ``ordre``) as chained rows of one log.  Each hash needs the one before: a single ordered pass, for the batch
    that is appended only."""
    heads = rows.sparkSession.createDataFrame([("", last_id, last_hash)], "journal string, id long, empreinte string")
    return append_by(rows.withColumn("journal", F.lit("")), "journal", heads).drop("journal")


#: Attempts of an append while other writers move the log's head, and the wait after the n-th, in n times so many seconds.
TRIES, WAIT = 5, 0.01


class HeadMoved(RuntimeError):
    """Other writers moved the head at each of the attempts."""


def append_to(path: str, rows: DataFrame, tries: int = TRIES) -> int:
    """Append ``rows`` to the stored log below ``path``, chained to its head; returns the number of the new part.

    Parts are numbered.  A part is written aside and takes the next number by a rename that fails if another writer has
    taken it: the head has moved, so the rows are chained again to the new one, up to ``tries`` times.
    """
    import time
    import uuid

    spark = rows.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs
    at = lambda p: jvm.Path(p)
    context = jvm.FileContext.getFileContext(at(path).toUri(), spark._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    for n in range(1, tries + 1):
        part, last_id, last_hash = head(spark, path)
        aside = f"{path}/_{uuid.uuid4().hex}"
        append(rows, last_id, last_hash).write.parquet(aside)
        try:
            context.rename(at(aside), at(f"{path}/part={part + 1:010d}"), plain)
            return part + 1
        except Exception as e:
            context.delete(at(aside), True)
            if "FileAlreadyExists" not in str(e):
                raise
            time.sleep(WAIT * n)
    raise HeadMoved(path)


def head(spark, path: str) -> tuple[int, int, str | None]:
    """(number of the last part, last id, last hash); only the last part is read."""
    jvm = spark._jvm.org.apache.hadoop.fs
    at = jvm.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    parts = [int(x[5:]) for x in names if x.startswith("part=")]
    if not parts:
        return 0, 0, None
    last = spark.read.schema(_LOG).parquet(f"{path}/part={max(parts):010d}").agg(F.max("id").alias("id"), F.max_by("empreinte", "id").alias("e")).first()
    return (max(parts), last.id, last.e) if last.id is not None else (max(parts), 0, None)


def verify(log: DataFrame, block: int = BLOCK, by: str | None = None) -> DataFrame:
    """One row (intact, premiere_rupture, nb_entrees), of each shard ``by`` if one is named: the first row that doesn't follow, and
    the rows up to it.

    One shuffle; ids are unique in a shard, so a block has at most ``block`` rows.  An empty log is intact.
    """
    keys = [by] if by else []
    d = log.select(*keys, "id", "horodatage", *_HASHED, "empreinte_precedente", "empreinte").withColumn("bloc", F.floor(F.col("id") / block))
    place = Window.partitionBy(*keys, "bloc").orderBy("id")
    d = d.withColumns({"precedent": F.lag("empreinte").over(place), "rang": F.row_number().over(place)})
    broken = (F.col("rang") > 1) & _breaks(F.col("precedent"))
    blocks = d.groupBy(*keys, "bloc").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(broken, F.struct("id", "rang"))).alias("rupture"),
        F.min(F.struct("id", "empreinte_precedente", "empreinte", "horodatage", *_HASHED)).alias("premier"), F.max_by("empreinte", "id").alias("fin"),
    )
    # from here on a row for each block
    border = Window.partitionBy(*keys).orderBy("bloc")
    e = blocks.select(*keys, "n", "rupture", "bloc", "premier.*", F.lag("fin").over(border).alias("precedent"), (F.sum("n").over(border) - F.col("n")).alias("avant"))
    first = F.when(_breaks(F.col("precedent")), F.struct("id", F.lit(1).alias("rang"))).otherwise(F.col("rupture"))
    e = e.select(*keys, "n", F.when(first.isNotNull(), F.struct(first["id"].alias("id"), (F.col("avant") + first["rang"]).alias("rang"))).alias("rupture"))
    e = e.groupBy(*keys).agg(F.min("rupture").alias("r"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return e.select(*keys, F.col("r").isNull().alias("intact"), F.col("r.id").alias("premiere_rupture"), F.coalesce(F.col("r.rang"), F.col("n")).cast("long").alias("nb_entrees"))


def _breaks(previous: Column) -> Column:
    """Whether a row doesn't follow a row with the hash ``previous`` (null: none)."""
    expected = link_hash(F.coalesce(previous, F.lit(GENESIS)))
    return ~F.col("empreinte_precedente").eqNullSafe(previous) | ~F.col("empreinte").eqNullSafe(expected)


def search(log: DataFrame, document: str | None = None, user: str | None = None, since=None, until=None, page: int = 1, size: int = 50) -> DataFrame:
    """A page of the log, newest first; bounds of time are inclusive, the size is 1 to 500."""
    tests = [("document_id", document, "__eq__"), ("utilisateur_id", user, "__eq__"), ("horodatage", since, "__ge__"), ("horodatage", until, "__le__")]
    wanted = [getattr(F.col(c), op)(F.lit(x)) for c, x, op in tests if x is not None]
    d = log.where(reduce(lambda a, b: a & b, wanted, F.lit(True)))
    size = max(1, min(500, size))
    return d.orderBy(F.desc("id")).offset((max(1, page) - 1) * size).limit(size)


def leaks(log: DataFrame) -> DataFrame:
    """Rows that break the log's invariants: an address, an IBAN or a card number in the details, or a malformed hash."""
    mail, iban = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"
    details = F.coalesce("details", F.lit(""))
    cards = F.exists(F.regexp_extract_all(details, F.lit("[0-9]{13,19}"), 0), card_valid)
    return log.where(details.rlike(f"{mail}|{iban}") | cards | ~F.coalesce("empreinte", F.lit("")).rlike("^[0-9a-f]{64}$"))
