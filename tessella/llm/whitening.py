"""Whitening of embeddings by cyclic Jacobi rotations.

Entries become integers, of which each different vector is fitted on once. Tasks add up centred
scatter matrices, and the driver, which gets one matrix of the vectors' dimensions whatever their
number, rotates it until nothing is left beside the diagonal. Rotations stop by a bound relative to
both diagonal entries, so small eigenvalues are as accurate as large ones. The sorted whitening matrix
is broadcast, and the whitened vectors' own covariance is measured in another pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import checkpoint, shuffle_width

#: Steps of an integer in one unit of an embedding's entry.
SCALE = 256
#: Dimensions above which the driver does not take the matrix (eight bytes for each pair of dimensions).
MAX_DIMENSIONS = 4096
#: Rounds over all pairs of dimensions after which rotations end in any case; about ten are enough.
MAX_SWEEPS = 60


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors (columns) of a symmetric matrix, by cyclic Jacobi rotations.

    A sweep goes through all pairs of rows in the order of a round-robin tournament, whose games of
    one round share no row and are rotated together. It ends when each entry beside the diagonal is
    within rounding of the root of the product of its two diagonal entries.
    """
    a = np.array(matrix, dtype=np.float64)
    d = len(a)
    vectors = np.eye(d)
    if d > 1:
        seats = np.arange(d + d % 2)  # with an odd number one sits out in each round
        eps = np.finfo(np.float64).eps
        for _ in range(MAX_SWEEPS):
            rotated = False
            for _ in range(len(seats) - 1):
                half = len(seats) // 2
                p, q = np.minimum(seats[:half], seats[half:][::-1]), np.maximum(seats[:half], seats[half:][::-1])
                p, q = p[q < d], q[q < d]
                off, x, y = a[p, q], a[p, p], a[q, q]
                wanted = np.abs(off) > eps * np.sqrt(np.abs(x) * np.abs(y))
                wanted &= np.abs(off) > 1e-300
                if wanted.any():
                    rotated = True
                    p, q, off, x, y = p[wanted], q[wanted], off[wanted], x[wanted], y[wanted]
                    with np.errstate(over="ignore"):
                        theta = (y - x) / (2 * off)
                        t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1))
                    c = 1 / np.hypot(t, 1)
                    s = t * c
                    for m in (a, vectors):
                        left, right = m[:, p].copy(), m[:, q].copy()
                        m[:, p], m[:, q] = c * left - s * right, s * left + c * right
                    left, right = a[p].copy(), a[q].copy()
                    a[p], a[q] = c[:, None] * left - s[:, None] * right, s[:, None] * left + c[:, None] * right
                    a[p, p], a[q, q] = x - t * off, y + t * off
                    a[p, q] = a[q, p] = 0.0
                seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
            if not rotated:
                break
    order = np.argsort(-a.diagonal(), kind="stable")
    return a.diagonal()[order], vectors[:, order]


def integers(vector: Column) -> Column:
    """Entries as integers, ``floor(256 * c)`` in double precision."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(0).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector is not null and all its entries are finite."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf")))), F.lit(False))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimensions)


def _summed(parts: DataFrame, height: int, width: int) -> np.ndarray:
    """Sum of matrices that come as rows ``(i, row)``: rows of equal ``i`` meet in one task, which holds one row for each ``i``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = _matrix(batch.column(1), width)
            for i, row in zip(batch.column(0).to_pylist(), rows, strict=True):
                held[i] = held[i] + row if i in held else row.copy()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int32()), pa.array([r.tolist() for r in held.values()], pa.list_(pa.float64()))], names=["i", "row"])

    width_of_shuffle = min(height, shuffle_width(parts.sparkSession))
    out = np.zeros((height, width))
    for r in parts.repartition(width_of_shuffle, "i").mapInArrow(add, "i int, row array<double>").collect():  # one row for each i
        out[r.i] = r.row
    return out


def scatter(rows: DataFrame, dimensions: int, change: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum of the outer products of ``change(x)`` (of ``size`` entries, centred) over ``rows(x)``; each task passes on one matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = change(_matrix(batch.column(0), dimensions))
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    return _summed(rows.select("x").mapInArrow(run, "i int, row array<double>"), size, size)


@dataclass
class Whitening:
    """What is fitted: number and sums of the fit list, falling eigenvalues, unit eigenvectors as columns, and the measured error."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float = 0.0
    widest: int = 0

    def project(self, x: np.ndarray, k: int) -> np.ndarray:
        """Whitened values of integer vectors on the first ``k`` components."""
        mean = np.array([s / self.n for s in self.sums])
        return (x - mean) @ (self.vectors[:, :k] / np.sqrt(self.values[:k]))


def fit(rows: DataFrame, components: int) -> Whitening | None:
    """Whitening of ``rows(x array<long>)``, of equal lengths, each different one counted once; None without rows.

    Components whose eigenvalue is nothing but rounding (within the dimensions' number of double
    precision's steps of the largest) are left out, so fewer than ``components`` may be there.
    """
    once = checkpoint(rows.select("x").distinct())
    total = once.select(F.count("*").alias("n"), F.max(F.size("x")).alias("d"), F.max(F.array_max(F.transform("x", F.abs))).alias("most")).first()
    if not total.n or not total.d:
        return None
    n, d = total.n, total.d
    if d > MAX_DIMENSIONS:
        raise ValueError(f"{d} dimensions; the matrix of at most {MAX_DIMENSIONS} goes to the driver")
    placed = once.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    sums = [0] * d
    for r in placed.collect():  # one row for each dimension
        sums[r.i] = int(r.s)
    mean = np.array([s / n for s in sums])
    cov = scatter(once, d, lambda x: x - mean, d) / n
    cov = (cov + cov.T) / 2
    values, vectors = jacobi(cov)
    real = int((values > max(values[0], 0) * d * np.finfo(np.float64).eps).sum())
    k = min(components, real)
    model = Whitening(n, sums, values[:k], vectors[:, :k], float(np.trace(cov)), widest=int(total.most))
    if k:  # their mean is zero, as x less its mean is projected
        model.error = float(np.abs(scatter(once, d, lambda x: model.project(x, k), k) / n - np.eye(k)).max())
    return model


RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` for each usable vector and component.

    Vectors that are null or hold null or non-finite entries are dropped, as are those of another
    length than most have (of equally frequent lengths the longer stays; empty ones count as null).
    Equal vectors are fitted on once, and each row gets its result, a row with a null key too. Where
    all vectors are equal, or fewer directions vary than ``components``, the others have no rows. A
    ``deviation`` too large for a long raises an error. An empty table gives no row. Other columns
    are ignored.
    """
    kind = dict(vectors.dtypes)[key]
    kept = vectors.where(usable(F.col(vector)) & (F.size(vector) > 0)).select(F.col(key).alias("__key"), integers(F.col(vector)).alias("x"))
    lengths = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = f"__key {kind}, {RESULT}"
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("__key", key)
    d = lengths.d
    kept = kept.where(F.size("x") == d)
    model = fit(kept, components)
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    k = len(model.values)
    small = d * (model.n * model.widest + max(abs(s) for s in model.sums)) ** 2 < 1 << 63

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sums = np.array(own.sums, dtype=np.int64 if small else object)
        share = own.values / own.trace if k else own.values
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = _matrix(batch.column(1), d)
            apart = own.n * (x if small else x.astype(object)) - sums
            deviation = [int(v) for v in (apart * apart).sum(axis=1)]
            rows = batch.num_rows
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(rows), k)))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, own.n)), pa.array([v for v in deviation for _ in range(k)], pa.int64()),
                 pa.array(own.project(x, k).ravel()), pa.array(np.tile(share, rows)), pa.array(np.full(rows * k, own.error))],
                names=["__key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return kept.select("__key", "x").mapInArrow(run, schema).withColumnRenamed("__key", key)
