"""Token-id output: documents in ascending id order as segments of directly addressable codes.

The texts are range-partitioned by doc_id (and a hash of the text, so that null
and repeated ids spread) and sorted: one shuffle, of the texts, which are smaller
than their ids.  They are encoded where they arrive, and written as rows (part,
seg, first_doc, last_doc, documents, ids, segment) through Spark's own writer, so
any store Spark can write to will do.  A segment is a row group of its own,
uncompressed, with the range of its ids in the statistics.

``read`` maps over the segments; a document's place in the whole is the number
of ids in earlier parts, earlier segments and earlier documents of its segment.
The driver holds one number a part.  ``tokens`` reads single ids: the ranges
lead to the row groups that hold the documents, and within a segment an id costs
a byte and a rank for each level.

Edge cases: null or empty text is the end token alone; null ids sort first and
stay null; repeated ids follow each other; an empty table has no segment.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from privlake.llm.common import shared_dir, table

END_ID = 2
SEGMENT_IDS = 1_000_000
SEGMENTS = "part int, seg int, first_doc long, last_doc long, n_docs long, n_ids long, segment binary"
#: A number for each segment of a megabyte is broadcast up to so many segments, else joined by shuffle.
BROADCAST_SEGMENTS = 200_000


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Write ``docs`` (doc_id, text) below ``path``; a segment ends after the document that fills it."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from privlake.llm import dac
        from privlake.llm.encoding import encoder

        encode, end = encoder(vocabulary).encode, end_id.to_bytes(4, "little")
        part, seg = TaskContext.get().partitionId(), 0
        names = [x.split()[0] for x in SEGMENTS.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

        def flush():
            lengths = np.array([len(x) // 4 for x in found], dtype=np.uint32)
            data = dac.encode(ids, lengths, np.frombuffer(b"".join(found), dtype="<u4"))
            row = (part, seg, ids[0], ids[-1], len(ids), int(lengths.sum()), data)
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

        ids, found, n = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc)
                found.append(encode(text.as_py()) + end)
                n += len(found[-1]) // 4
                if n >= segment_ids:
                    yield flush()
                    ids, found, n, seg = [], [], 0, seg + 1
        if ids:
            yield flush()

    d = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    d = d.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    w = d.select("doc_id", "text").mapInArrow(run, SEGMENTS).write.option("compression", "none")
    # a row group for each segment
    w.option("parquet.block.row.count.limit", 1).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files below ``path``."""

    def run(batches) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        from privlake.llm import dac

        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = dac.Segment(data.as_py())
                ends = np.cumsum(s.lengths, dtype=np.int64)
                begins = ends - s.lengths
                crcs = [zlib.crc32(s.slice(a, b).astype("<u4").tobytes()) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(s.docs, pa.int64()), pa.array(begins + start), pa.array(s.lengths.astype(np.int64)), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.read.schema(SEGMENTS).parquet(path)
    before, parts = 0, []
    for part, n in sorted(map(tuple, files.groupBy("part").agg(F.sum("n_ids")).collect())):
        parts.append((part, before))
        before += n
    earlier = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1))
    starts = files.select("part", "seg", F.coalesce(earlier, F.lit(0)).alias("in_part"))
    starts = starts.join(F.broadcast(spark.createDataFrame(parts, "part int, first long")), "part")
    starts = starts.select("part", "seg", (F.col("in_part") + F.col("first")).alias("start"))
    few = files.limit(BROADCAST_SEGMENTS + 1).count() <= BROADCAST_SEGMENTS
    placed = files.select("part", "seg", "segment").join(F.broadcast(starts) if few else starts, ["part", "seg"])
    return placed.select("start", "segment").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens(spark: SparkSession, path: str, doc_id: int, places: list[int] | None = None) -> DataFrame:
    """(doc_id, copy, place, token) of some places of a document below ``path``, or of all of them: without decoding
    what lies around.

    Only the row groups whose range of ids holds ``doc_id`` are read.  A place beyond the document's end gives no
    row; of rows with the same id each is a ``copy`` of its own.
    """

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from privlake.llm import dac

        for batch in batches:
            for part, seg, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = dac.Segment(data.as_py())
                begins = np.cumsum(s.lengths, dtype=np.int64) - s.lengths
                for k in [k for k, d in enumerate(s.docs) if d == doc_id]:
                    n = int(s.lengths[k])
                    if places is None:
                        at, ids = list(range(n)), s.slice(int(begins[k]), int(begins[k]) + n).tolist()
                    else:
                        at = [i for i in places if 0 <= i < n]
                        ids = [s[int(begins[k]) + i] for i in at]
                    rows = [[doc_id] * len(at), [(part << 42) + (seg << 21) + k] * len(at), at, ids]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["doc_id", "copy", "place", "token"])

    files = spark.read.schema(SEGMENTS).parquet(path).where((F.col("first_doc") <= doc_id) | F.col("first_doc").isNull()).where(F.col("last_doc") >= doc_id)
    return files.select("part", "seg", "segment").mapInArrow(run, "doc_id long, copy long, place long, token long")


def token(spark: SparkSession, path: str, doc_id: int, i: int) -> int | None:
    """The i-th id of a document (the first of those with this id), null beyond its end."""
    rows = tokens(spark, path, doc_id, [i]).orderBy("copy").limit(1).collect()
    return rows[0].token if rows else None


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark)
    write(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, path)
