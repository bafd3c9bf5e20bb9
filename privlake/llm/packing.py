"""Packing of documents into sequences of at most ``size`` tokens.

Each document is tokenised where it is read; only the lengths travel.  Full
pieces of ``size`` tokens are sequences of their own.  The rests are dealt into
randomised groups of about ``GROUP_ROWS`` pieces by a hash of (input partition,
position), so no key of the data decides the group, and each group is packed by
first-fit decreasing, where a tournament tree over the bins' free space finds
the first bin that fits in O(log bins).  More data means more groups, not larger ones.

Edge cases: null or empty text is the end token alone; a null doc_id is kept;
repeated rows are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from privlake.llm.common import stored, table

SIZE = 2048
END_ID = 1
GROUP_ROWS = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, grp long, sequence_id long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class TournamentTree:
    """Free space of bins; ``place(n)`` puts n into the first bin with room and returns (bin, offset)."""

    def __init__(self, bins: int, size: int):
        self.size, self.leaves = size, 1 << max(0, (bins - 1).bit_length())
        self.free = [size] * (2 * self.leaves)

    def place(self, n: int) -> tuple[int, int]:
        free, i = self.free, 1
        while i < self.leaves:
            i *= 2
            if free[i] < n:
                i += 1
        offset = self.size - free[i]
        free[i] -= n
        at = i - self.leaves
        while i > 1:
            i //= 2
            free[i] = max(free[2 * i], free[2 * i + 1])
        return at, offset


def first_fit_decreasing(lengths: list[int], size: int = SIZE) -> list[tuple[int, int]]:
    """(bin, offset) of each length, in the order given; every length is 1 to ``size``."""
    tree, out = TournamentTree(max(1, len(lengths)), size), [(0, 0)] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        out[k] = tree.place(lengths[k])
    return out


def pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = END_ID, groups: int = 1) -> DataFrame:
    """A row for each piece; ``grp`` is -1 for a full piece, which has its sequence_id already."""

    def run(batches) -> Iterator:
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        from privlake.llm.encoding import encoder

        encode, end = encoder(vocabulary).encode, end_id.to_bytes(4, "little")
        part, seen, full = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                n = len(ids) // 4
                seen += 1
                for start in range(0, n, size):
                    length = min(size, n - start)
                    grp = -1 if length == size else zlib.crc32(b"%d:%d" % (part, seen)) % groups
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    for column, x in zip(rows, (doc, start, length, crc, n, grp, (part << 33) + 2 * full), strict=True):
                        column.append(x)
                    full += grp < 0
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], [x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """``docs`` (doc_id, text) as pieces placed in sequences."""

    def place(key, group):
        at = first_fit_decreasing(group["length"].tolist(), size)
        group["sequence_id"] = [(key[0] << 33) + 2 * k + 1 for k, _ in at]
        group["offset"] = [o for _, o in at]
        return group.drop(columns="grp")

    groups = max(1, -(-docs.count() // GROUP_ROWS))
    # written once, as numbers: both kinds of pieces come from one pass over the texts
    cut = stored(pieces(docs, vocabulary, size, end_id, groups)).withColumn("offset", F.lit(0).cast("long"))
    names = [x.split()[0] for x in PACKED.split(", ")]
    full = cut.where("grp < 0").select(*names)
    rest = cut.where("grp >= 0").groupBy("grp").applyInPandas(place, PACKED)
    return full.unionByName(rest)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
