"""Centroid clustering: Lloyd's iterations on distinct quantised vectors with multiplicities.

Vectors are quantised to whole numbers and grouped, with partial counts before
the shuffle, so a vector that a third of the rows hold is one weighted row.  The
iterations read the stored distinct vectors: each task assigns its own and sends
a sum and a weight for each cluster and component, all in whole numbers, so the
result doesn't depend on partitions.  The driver holds the centroids and nothing
else (k times the vectors' length).

The last assignment is joined back to the rows by a SHA-256 of the vector (not by
the vector, which is longer); it is a plain equi-join of stored rows, in which
Spark splits the partitions of hot vectors and broadcasts the distinct side
only below its own threshold of size.

Edge cases: a vector that is null, of another length than ``width`` or holds a
null or non-finite entry has no row in the result; a null id is kept, after all
others where the first centroids are chosen; repeated ids and rows are clustered
one by one; fewer than ``k`` vectors start as many centroids; two centroids that
are equal leave the later one empty, and an empty one stays where it is; an empty
table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from privlake.llm.common import shared_dir, stored, table
from privlake.llm.vectors import finite, matrix, quantised

WIDTH, K, ROUNDS = 64, 16, 3


def quantise(vectors: DataFrame, id_col: str, vector_col: str, width: int) -> DataFrame:
    """(id, q, digest) of the vectors that take part."""
    v = F.col(vector_col)
    d = vectors.where((F.size(v) == width) & finite(v)).select(F.col(id_col).cast("long").alias("id"), quantised(v).alias("q"))
    return d.withColumn("digest", F.unhex(F.sha2(F.array_join("q", ","), 256)))


def first_centroids(rows: DataFrame, k: int) -> list[list[int]]:
    """The ``k`` vectors with the least SHA-256 of ``1:<id>``; ties by the vector."""
    h = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    return [list(r.q) for r in rows.select(h.alias("h"), "q", "digest").orderBy(F.col("h").asc_nulls_last(), "digest").limit(k).collect()]


def nearest(x, centroids):
    """(number of the nearest centroid, squared distance) of the rows of a whole-number matrix; ties go to the smaller number."""
    import numpy as np

    c = np.array(centroids, dtype=np.int64).reshape(-1, x.shape[1])
    widest = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 16 * x.shape[1] * widest * widest < 1 << 53:  # every sum below is a whole number that a double holds
        x, c = x.astype(float), c.astype(float)
        d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
    else:
        x, c = x.astype(object), c.astype(object)
        d = np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)
    best = np.argmin(d, axis=1)
    return best, d[np.arange(len(best)), best].astype(np.int64)


def _sums(distinct: DataFrame, centroids: list[list[int]], width: int) -> dict[tuple[int, int], tuple[int, int]]:
    """Sum and weight by (cluster, component): k * width rows on the driver."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        weight = [0] * len(centroids)
        total = np.zeros((len(centroids), width), dtype=object)
        for batch in batches:
            if batch.num_rows:
                x, w = matrix(batch.column(0), width), batch.column(1).to_numpy()
                best, _ = nearest(x, centroids)
                for c in np.unique(best):
                    mine = best == c
                    y, n = x[mine], w[mine]
                    wide = float(np.abs(y).max(initial=0)) * float(n.sum()) >= 2.0**62
                    total[c] += (y.astype(object) * n[:, None]).sum(0) if wide else (y * n[:, None]).sum(0).astype(object)
                    weight[c] += int(n.sum())
        rows = [(c, i, s, weight[c]) for c in range(len(centroids)) if weight[c] for i, s in enumerate(total[c])]
        yield pa.RecordBatch.from_pylist([dict(zip(("c", "i", "s", "n"), r, strict=True)) for r in rows], pa.schema([("c", pa.int32()), ("i", pa.int32()), ("s", pa.decimal128(38)), ("n", pa.int64())]))

    d = distinct.select("q", "n").mapInArrow(run, "c int, i int, s decimal(38,0), n long")
    return {(r.c, r.i): (int(r.s), r.n) for r in d.groupBy("c", "i").agg(F.sum("s").cast("decimal(38,0)").alias("s"), F.sum("n").alias("n")).collect()}


def lloyd(distinct: DataFrame, centroids: list[list[int]], rounds: int, width: int) -> list[list[int]]:
    """The centroids after ``rounds`` of assignment and replacement by the floor of the weighted mean."""
    for _ in range(rounds if centroids else 0):
        sums = _sums(distinct, centroids, width)
        moved = lambda c, i, was: sums[c, i][0] // sums[c, i][1] if (c, i) in sums else was  # noqa: B023, E731
        centroids = [[moved(c, i, was) for i, was in enumerate(row)] for c, row in enumerate(centroids)]
    return centroids


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) of every vector that takes part."""
    spark, base = vectors.sparkSession, shared_dir(vectors.sparkSession)
    rows = quantise(vectors, id_col, vector_col, width)
    distinct = stored(rows.groupBy("digest", "q").agg(F.count(F.lit(1)).alias("n")), f"{base}/distinct")
    centroids = lloyd(distinct, first_centroids(rows, k), rounds, width)

    def assign(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                best, distance = nearest(matrix(batch.column(1), width), centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32()), pa.array(distance), batch.column(2)], ["digest", "cluster", "distance", "n"])

    assigned = stored(distinct.select("digest", "q", "n").mapInArrow(assign, "digest binary, cluster int, distance long, n long"), f"{base}/assigned")
    inertia = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("n")).alias("s")).collect()}  # k rows
    of = spark.createDataFrame(
        [(c, inertia[c], sum(inertia.values()), row) for c, row in enumerate(centroids) if c in inertia], "cluster int, cluster_inertia long, inertia long, centroid array<long>"
    )
    placed = rows.select("id", "digest").join(assigned.select("digest", "cluster", "distance"), "digest")
    return placed.join(F.broadcast(of), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # k rows


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    sha = F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256")
    return d.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", sha)


def oracle(width: int = WIDTH, k: int = K, rounds: int = ROUNDS) -> str:
    """The same in SQL, a round after the other."""
    near = lambda c: (
        f"SELECT vec_id, q, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.vec_id, v.q, z.c, list_sum(list_transform(range(1, {width} + 1), lambda i: (v.q[i] - z.q[i]) * (v.q[i] - z.q[i])))::bigint AS d "
        f"FROM v, {c} z) GROUP BY vec_id, q"
    )
    parts = [
        f"v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) AS q FROM embeddings "
        f"WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::double))) = 0)",
        f"c0 AS (SELECT (row_number() OVER (ORDER BY h) - 1)::int AS c, q FROM (SELECT sha256('1:' || vec_id::varchar) AS h, q FROM v ORDER BY h LIMIT {k}))",
    ]
    for r in range(1, rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED ({near(f'c{r - 1}')})")
        parts.append(
            f"m{r} AS (SELECT c, list(x ORDER BY i) AS q FROM (SELECT c, i, floor(sum(q[i])::double / count(*))::bigint AS x FROM a{r}, range(1, {width} + 1) t(i) GROUP BY c, i) GROUP BY c)"
        )
        parts.append(f"c{r} AS MATERIALIZED (SELECT z.c, coalesce(m.q, z.q) AS q FROM c{r - 1} z LEFT JOIN m{r} m USING (c))")
    parts.append(f"f AS MATERIALIZED ({near(f'c{rounds}')})")
    return (
        f"WITH {', '.join(parts)} SELECT f.vec_id, f.c::int AS cluster, f.d AS distance, (sum(f.d) OVER (PARTITION BY f.c))::bigint AS cluster_inertia, (sum(f.d) OVER ())::bigint AS inertia, "
        f"sha256(array_to_string(z.q, ',')) AS centroid_sha256 FROM f JOIN c{rounds} z USING (c)"
    )
