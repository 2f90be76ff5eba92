"""Embedding whitening by the covariance of exactly centred rows.

Entries become whole numbers (256 times the entry, rounded down).  The
covariance is fitted on the distinct whole vectors: their number and sums are
exact, each row is centred by the whole part of the mean in whole numbers and
then by its remainder, and a ``RowMatrix`` of these rows gives the Gramian
matrix, which is divided by the number of rows.  The driver decomposes that one
matrix (its size is the square of the dimension), and the whitening matrix is
broadcast to a narrow map over all rows.

Defined results: vectors that are null or hold null, NaN or infinite entries
are dropped, as are vectors of another length than most usable vectors have (of
equally frequent lengths the longest) and empty ones, which have no components.
Entries whose whole number does not fit in 53 bits are taken at that bound.
A repeated vector counts once in the fit, and each of its rows is returned.
Directions whose eigenvalue is zero to double precision have a null ``whitened``
and an ``explained`` of 0; with no other direction ``identity_error`` is 0.  A
``deviation`` beyond the range of long is null.  Ids pass through, be they null,
repeated or strings; other columns are never read; an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_before, as_text, bounded_batches, discard, materialize

#: Entries are multiplied by this before they are rounded down.
SCALE = 256.0
#: Whole numbers up to here are exact as doubles.
LARGEST = float(1 << 53)


@dataclass
class Whitening:
    """A fit: rows, exact sums, eigenvalues (falling) and unit eigenvectors."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def live(self, k: int) -> np.ndarray:
        """Which of the first k eigenvalues are above the rounding of the matrix."""
        top = self.values[:k]
        return top > max(self.values[0], 0.0) * len(self.values) * np.finfo(float).eps if len(top) else top > 0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n of whole rows: the whole part first, where nothing is lost."""
        whole, rest = np.array([divmod(s, self.n) for s in self.sums], object).reshape(-1, 2).T
        return (x - whole.astype(np.int64)).astype(np.float64) - np.array([r / self.n for r in rest])

    def project(self, x: np.ndarray, k: int) -> np.ndarray:
        """The first k whitened components of whole rows; NaN for dead directions."""
        live = self.live(k)
        scale = np.where(live, 1.0 / np.sqrt(np.where(live, self.values[:k], 1.0)), np.nan)
        return (self.centred(x) @ self.vectors[:, :k]) * scale

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n x - S)^2, exact, as whole numbers of any size."""
        near = np.abs(self.centred(x)).max(initial=0.0) * self.n + 1
        if near * near * max(1, x.shape[1]) < 2.0**62 and np.abs(x).max(initial=0) * float(self.n) < 2.0**62:
            d = x * self.n - np.array(self.sums, np.int64)
            return (d * d).sum(axis=1)
        sums = np.array(self.sums, object)
        d = x.astype(object) * self.n - sums
        return (d * d).sum(axis=1)


def usable(df: DataFrame, col: str) -> tuple[DataFrame, int]:
    """Rows of good vectors of the usual length with their whole numbers ``x``; the length."""
    v = F.col(col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    good = df.where(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(False)))
    usual = good.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = usual[0]["d"] if usual else 0
    return good.where(F.size(v) == d).withColumn("x", _whole(v)), d


def _whole(v: Column) -> Column:
    bound = lambda c: F.greatest(F.least(c, F.lit(LARGEST)), F.lit(-LARGEST))
    return F.transform(v.cast("array<double>"), lambda c: F.floor(bound(c * SCALE)).cast("long"))


def _rows(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def exact_sums(distinct: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each dimension."""

    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in it:
            x = _rows(batch.column(0))
            if not len(x):
                continue
            n += len(x)
            # halves of 32 bits add up exactly, whatever the number of rows in a batch
            high, low = x >> 32, x & 0xFFFFFFFF
            own = high.sum(axis=0).astype(object) * (1 << 32) + low.sum(axis=0).astype(object)
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"dim": list(range(-1, len(total))), "s": [str(n), *map(str, total)]}, pa.schema([("dim", pa.int32()), ("s", pa.string())]))

    sums = distinct.select("x").mapInArrow(partial, "dim int, s string")
    rows = sums.groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # one row a dimension
    found = {r["dim"]: int(r["s"]) for r in rows}
    n = found.pop(-1, 0)
    return n, [found[i] for i in range(len(found))]


def fit(spark: SparkSession, rows: DataFrame, components: int) -> Whitening:
    """The whitening of the distinct ``x`` of rows."""
    distinct = materialize(spark, rows.select("x").distinct())
    try:
        n, sums = exact_sums(distinct)
        if not n:
            return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
        means = [divmod(s, n) for s in sums]
        whole, rest = F.lit([w for w, _ in means]), F.lit([r / n for _, r in means])
        centred = F.zip_with(F.zip_with("x", whole, lambda x, w: (x - w).cast("double")), rest, lambda x, r: x - r)
        frame = MLUtils.convertVectorColumnsFromML(distinct.select(array_to_vector(centred).alias("row")), "row")
        gram = np.array(RowMatrix(frame, n, len(sums)).computeGramianMatrix().toArray())
        cov = (gram + gram.T) / 2 / n
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(-values, kind="stable")
        found = Whitening(n, sums, values[order], vectors[:, order], float(np.trace(cov)))
        found.identity_error = identity_error(spark, distinct, found, components)
        return found
    finally:
        discard(spark, distinct)


def identity_error(spark: SparkSession, distinct: DataFrame, w: Whitening, components: int) -> float:
    """Largest absolute entry of the covariance of whitened rows minus the identity."""
    k = int(w.live(components).sum())  # eigenvalues fall, so live ones stand first
    if not k:
        return 0.0
    shared = spark.sparkContext.broadcast(w)

    def project(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                z = shared.value.project(_rows(batch.column(0)), k)
                yield pa.RecordBatch.from_arrays([pa.array(z[:, i]) for i in range(k)], names=[f"c{i}" for i in range(k)])

    z = distinct.select("x").mapInArrow(project, ", ".join(f"c{i} double" for i in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    # covariances by centred updates, one row
    got = z.agg(*[F.covar_pop(f"c{i}", f"c{j}").alias(f"p{i}_{j}") for i, j in pairs]).collect()[0]
    return max(abs(got[f"p{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(spark: SparkSession, df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 4) -> DataFrame:
    """Per usable row and component up to ``components``: (id, component, n,
    deviation, whitened, explained, identity_error)."""
    bounded_batches(spark)
    rows, _ = usable(df.select(as_text(df, id_col).alias("_id"), F.col(vec_col).alias("_v")), "_v")
    w = fit(spark, rows, components)
    k = min(components, len(w.values))
    live = w.live(k)
    explained = [float(v / w.trace) if ok else 0.0 for v, ok in zip(w.values[:k], live, strict=True)]
    shared = spark.sparkContext.broadcast(w)
    schema = "_id string, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def project(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for pdf in it:
            if not len(pdf) or not k:
                continue
            x = np.stack(pdf["x"].to_list())
            z, m = w.project(x, k), len(x)
            far = [int(v) if v < 1 << 63 else None for v in w.deviation(x)]
            yield pd.DataFrame(
                {
                    "_id": np.repeat(pdf["_id"].to_numpy(object), k), "component": np.tile(np.arange(1, k + 1), m), "n": w.n, "deviation": pd.array(far, "Int64").repeat(k),
                    "whitened": pd.array(z.ravel(), pd.ArrowDtype(pa.float64())) if live.all() else [None if np.isnan(v) else v for v in z.ravel()],
                    "explained": np.tile(explained, m), "identity_error": w.identity_error,
                }
            )

    out = rows.select("_id", "x").mapInPandas(project, schema).withColumnRenamed("_id", id_col)
    return as_before(out, df, id_col)
