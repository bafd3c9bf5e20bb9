"""Embedding whitening by TSQR, without forming a covariance matrix.

Components become whole numbers, and equal vectors count once: the fit list.  Its
sums are exact (whole numbers, added by dimension), so every row is centred to
within one rounding: the part of the mean that is a whole number is taken off
exactly, then the rest.  Each partition of the stored fit list keeps the R of a QR
of its centred rows, batch by batch; the Rs are merged in groups, level by
level, each the QR of the stacked Rs.  The last R has the singular values and right
vectors of all centred rows: e = s^2 / n, components are the right vectors, and
a row's whitened coordinate is its projection over sqrt(e).

``fit`` brings one R to the driver, d x d numbers whatever the number of rows, and
the model goes to the tasks with their code.  A vector that a third of the rows
hold is one row of the fit list, counted with partial sums before the shuffle.

Edge cases: a vector that is null, empty or holds a null or non-finite entry has no
row; vectors of different lengths are fitted apart, each length a model of its own;
components whose eigenvalue is zero to working precision (equal vectors, constant or
dependent dimensions, fewer vectors than dimensions) have no rows, as nothing can
be divided by it; null and repeated ids are kept, each row with its own result; an
empty table gives no row.  ``deviation`` is a decimal: the query's cast to long
fails, rather than wraps, beyond 2^63.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from privlake.llm.common import shared_dir, stored, table
from privlake.llm.vectors import finite, matrix, quantised

SHIFT, COMPONENTS, FAN = 1_000_000, 16, 16


@dataclass
class Model:
    """Of one length of vectors: n of the fit list, sums by dimension, right vectors as rows, eigenvalues, their sum."""

    n: int
    sums: list[int]
    vectors: object
    values: object
    trace: float
    identity_error: float = 0.0

    def centred(self, x):
        """x - sums / n: the whole part of the mean comes off exactly."""
        import numpy as np

        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole) - rest

    def whitened(self, x, k: int):
        import numpy as np

        return self.centred(x) @ self.vectors[:k].T / np.sqrt(self.values[:k])

    def deviation(self, x) -> list[int]:
        """Exact sum over the dimensions of (n * x - sums)^2."""
        import numpy as np

        far = max((abs(int(b) * self.n - s) for col, s in zip(x.T, self.sums, strict=True) for b in (col.min(), col.max())), default=0)
        kind = np.int64 if far * far * max(x.shape[1], 1) < 1 << 62 and far < 1 << 31 and self.n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 62 else object
        y = x.astype(kind) * self.n - np.array(self.sums, dtype=kind)
        return [int(v) for v in (y * y).sum(1)]


def quantise(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, d, x) of the vectors that take part."""
    v = F.col(vector_col)
    d = vectors.where((F.size(v) > 0) & finite(v))
    return d.select(F.col(id_col).cast("long").alias("id"), F.size(v).alias("d"), quantised(v, SHIFT).alias("x"))


def _by_length(batch, at_d: int, at_x: int):
    """(length, rows, matrix) of each length of vectors in a batch."""
    import numpy as np
    import pyarrow as pa

    d = batch.column(at_d).to_numpy()
    for width in np.unique(d):
        rows = np.flatnonzero(d == width)
        yield int(width), rows, matrix(batch.column(at_x).take(pa.array(rows)), int(width))


def exact_sums(fit_list: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """n and the sums by dimension for each length, exact: a row a dimension on the driver."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        found: dict[int, list] = {}
        for batch in batches:
            for width, _, x in _by_length(batch, 0, 1):
                one = found.setdefault(width, [0, np.zeros(width, dtype=object)])
                one[0] += len(x)
                one[1] += x.sum(0).astype(object)  # 2^40 * rows of a batch stay far below 2^63
        rows = [{"d": d, "i": i, "n": n, "s": s} for d, (n, sums) in found.items() for i, s in enumerate(sums)]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("d", pa.int32()), ("i", pa.int32()), ("n", pa.int64()), ("s", pa.decimal128(38))]))

    d = fit_list.select("d", "x").mapInArrow(run, "d int, i int, n long, s decimal(38,0)")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in d.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")).orderBy("d", "i").collect():
        out.setdefault(r.d, (r.n, []))[1].append(int(r.s))
    return out


def _fold(r, x):
    """R of the rows of R and x together."""
    import numpy as np

    return np.linalg.qr(x if r is None else np.vstack([r, x]), mode="r")


def _emit(found: dict) -> Iterator:
    import numpy as np
    import pyarrow as pa

    if found:
        rows = [{"d": d, "r": np.ascontiguousarray(r).tobytes()} for d, r in found.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("d", pa.int32()), ("r", pa.binary())]))


def tsqr(fit_list: DataFrame, models: dict[int, Model], base: str) -> dict[int, object]:
    """The R of all centred rows, by length."""
    import numpy as np

    def leaf(batches) -> Iterator:
        found: dict = {}
        for batch in batches:
            for d, _, x in _by_length(batch, 0, 1):
                found[d] = _fold(found.get(d), models[d].centred(x))
        yield from _emit(found)

    def merge(batches) -> Iterator:
        import numpy as np

        found: dict = {}
        for batch in batches:
            for d, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[d] = _fold(found.get(d), np.frombuffer(r).reshape(-1, d))
        yield from _emit(found)

    rs, level = stored(fit_list.select("d", "x").mapInArrow(leaf, "d int, r binary"), f"{base}/r0"), 0
    while (count := rs.count()) > max(FAN, len(models)):
        level += 1
        parts = max(1, -(-count // FAN))
        rs = stored(rs.repartition(parts).mapInArrow(merge, "d int, r binary"), f"{base}/r{level}")
        if rs.count() >= count:  # more lengths than Rs can be merged
            break
    found: dict = {}
    for d, r in map(tuple, rs.toLocalIterator()):  # the root of the tree
        found[d] = _fold(found.get(d), np.frombuffer(bytes(r)).reshape(-1, d))
    return found


def fit(fit_list: DataFrame, components: int, base: str) -> dict[int, Model]:
    """A model for each length of the vectors in the stored ``fit_list`` (d, x)."""
    import numpy as np

    models = {d: Model(n, sums, np.zeros((0, d)), np.zeros(0), 0.0) for d, (n, sums) in exact_sums(fit_list).items()}
    for d, r in tsqr(fit_list, models, base).items():
        _, s, v = np.linalg.svd(r)
        m = models[d]
        m.trace = float((s * s).sum()) / m.n
        real = int((s > s[0] * max(m.n, d) * np.finfo(float).eps).sum()) if len(s) and s[0] > 0 else 0
        v, m.values = v[:real], (s * s / m.n)[:real]
        m.vectors = v * np.sign(v[np.arange(real), np.abs(v).argmax(1)])[:, None]
    _identity_errors(fit_list, models, components)
    return models


def _identity_errors(fit_list: DataFrame, models: dict[int, Model], k: int) -> None:
    """Largest entry of the whitened fit list's covariance less the identity: one pass for the means, one for products."""
    import numpy as np

    def totals(of) -> dict[int, object]:
        def run(batches) -> Iterator:
            import pyarrow as pa

            found: dict = {}
            for batch in batches:
                for d, _, x in _by_length(batch, 0, 1):
                    if len(models[d].values):
                        found[d] = found.get(d, 0) + of(d, models[d].whitened(x, k))
            rows = [{"d": d, "i": i, "v": float(v)} for d, t in found.items() for i, v in enumerate(t.ravel())]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("d", pa.int32()), ("i", pa.int32()), ("v", pa.float64())]))

        out: dict = {}
        for r in fit_list.select("d", "x").mapInArrow(run, "d int, i int, v double").groupBy("d", "i").agg(F.sum("v").alias("v")).orderBy("d", "i").collect():  # k * k rows a length
            out.setdefault(r.d, []).append(r.v)
        return {d: np.array(v) for d, v in out.items()}

    means = {d: v / models[d].n for d, v in totals(lambda d, w: w.sum(0)).items()}
    for d, v in totals(lambda d, w: (w - means[d]).T @ (w - means[d])).items():
        m = len(means[d])
        models[d].identity_error = float(np.abs(v.reshape(m, m) / models[d].n - np.eye(m)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: id, d, component, n, deviation, whitened, explained, identity_error."""
    base = shared_dir(vectors.sparkSession)
    rows = quantise(vectors, id_col, vector_col)
    fit_list = stored(rows.select("d", "x").distinct(), f"{base}/fit")
    models = fit(fit_list, components, base)

    def run(batches) -> Iterator:
        import decimal

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for d, at, x in _by_length(batch, 1, 2):
                m = models[d]
                k = min(components, len(m.values))
                w = m.whitened(x, k)
                ids, dev = batch.column(0).take(pa.array(np.repeat(at, k))), m.deviation(x)
                dev = pa.array([decimal.Decimal(v) for v in dev], pa.decimal128(38)).take(pa.array(np.repeat(np.arange(len(x)), k)))
                full = lambda v, kind: pa.array(np.full(len(x) * k, v), kind)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([
                    ids, full(d, pa.int32()), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), full(m.n, pa.int64()), dev, pa.array(w.ravel()),
                    pa.array(np.tile(m.values[:k] / m.trace if k else np.zeros(0), len(x))), full(m.identity_error, pa.float64()),
                ], ["id", "d", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, "id long, d int, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return d.select(F.col("id").alias("vec_id"), "component", "n", F.col("deviation").cast("long").alias("deviation"), "whitened", "explained", "identity_error")
