"""Whitening of embeddings by matrix-free block subspace iteration.

The covariance matrix is never formed.  A pass over the fit list computes V Q = X'(X Q) / n for a block Q of a few more
columns than components are wanted, with the rows of X centred first.  Each cycle orthonormalises the block (QR), solves the
small projected problem (Rayleigh-Ritz), and measures the residual |V q - e q| of every component; the block then goes through
a Chebyshev polynomial in V, one pass for each degree, which damps what lies between zero and the block's least Ritz value.  The
iteration ends when the residuals certify all k components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import giving_back, materialize, workspace

#: x = floor(64 * c) + 1000000.
SCALE, SHIFT = 64.0, 1_000_000
#: Beyond this a floor has no exact double or long anyway.
LARGEST = float(1 << 62)


def _is_whole(vector: Column) -> Column:
    """Whether a vector is there and all its entries are there and finite."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def _levels(vector: Column, dims: int) -> Column:
    """The long of each entry; what a shorter vector lacks counts as 0."""
    levels = F.transform(vector, lambda c: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), SCALE * c.cast("double")))) + SHIFT)
    return F.concat(levels, F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(dims) - F.size(vector)))


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


@dataclass
class Fit:
    """n distinct vectors with sums S by dimension; unit eigenvectors as columns, by falling eigenvalue; the trace of V."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residual: float = 0.0
    passes: int = 0
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _totals(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums; tasks send halves of 31 bits, whose sums can't overflow."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            n += len(x)
            high += (x >> 31).sum(axis=0)
            low += (x & 0x7FFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dims), pa.int32()), pa.array([0, *high.tolist()], pa.int64()), pa.array([n, *low.tolist()], pa.int64())], names=["dim", "high", "low"])

    wide = "decimal(38,0)"
    rows = fit.mapInArrow(giving_back(partial), "dim int, high long, low long").groupBy("dim").agg(F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low")).collect()  # a row per dimension
    got = {r["dim"]: (int(r["high"]) << 31) + int(r["low"]) for r in rows}
    return got.pop(-1, 0), [got[j] for j in sorted(got)]


def _summed(fit: DataFrame, of, rows: int, columns: int) -> np.ndarray:
    """The sum over all batches of a matrix that `of` makes of a batch's vectors: once for each task, then by row in a shuffle."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, columns))
        for batch in batches:
            total += of(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), *(pa.array(np.ascontiguousarray(total[:, j])) for j in range(columns))], names=["row", *(f"s{j}" for j in range(columns))])

    parts = fit.mapInArrow(giving_back(partial), "row int, " + ", ".join(f"s{j} double" for j in range(columns)))
    got = parts.groupBy("row").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(columns)]).collect()  # dimensions by block
    out = np.zeros((rows, columns))
    for r in got:
        out[r["row"]] = r[1:]
    return out


def _pass(fit: DataFrame, mean: np.ndarray, block: np.ndarray, n: int) -> np.ndarray:
    """V Q of a block Q, and in a last column of its first row the trace of V."""
    dims, width = block.shape

    def of(column: pa.ListArray) -> np.ndarray:
        x = _matrix(column, dims) - mean
        out = np.zeros((dims, width + 1))
        out[:, :width] = x.T @ (x @ block)
        out[0, width] = np.einsum("ij,ij->", x, x)
        return out

    return _summed(fit, of, dims, width + 1) / n


def _growth(t: float) -> float:
    """By how much a Chebyshev polynomial grows with each degree at t >= 1."""
    return t + math.sqrt(max(t * t - 1, 0.0))


def subspace_iteration(product, dims: int, k: int, *, oversample: int = 2, degree: int = 12, tolerance: float = 2e-14, most_passes: int = 3000, seed: int = 42):
    """The k leading eigenpairs of a positive semidefinite V of which only product(Q) = V Q is known.

    Returns vectors, values, the largest residual over the largest value, and the number of passes.  The block has
    (1 + oversample) * k columns.  The tolerance is relative to the largest value; where rounding keeps residuals above it, the
    iteration ends when they have stopped falling and are below 1e-10, else it fails after most_passes.
    """
    width = min(dims, (1 + oversample) * k)
    k = min(k, width)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, width)))[0]
    passes, best, since = 0, math.inf, 0
    while True:
        image, passes = product(q), passes + 1
        small = q.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        top = max(values[0], 0.0)
        worst = float(np.linalg.norm(image[:, :k] - q[:, :k] * values[:k], axis=0).max())
        since = 0 if worst < best / 2 else since + 1
        best = min(best, worst)
        if worst <= tolerance * top or (since >= 2 and worst <= 1e-10 * top):
            return q[:, :k], values[:k], worst / top if top else 0.0, passes
        if passes >= most_passes:
            raise RuntimeError(f"residual {worst / top:.3g} after {passes} passes")
        edge = max(values[-1], 1e-12 * top) / 2  # [0, 2 * edge] is damped
        here = lambda value: _growth(max((value - edge) / edge, 1.0))
        spread = math.log(here(values[0]) / here(values[k - 1]))
        steps = max(1, min(degree, int(18 / spread) if spread > 0 else degree))  # keeps a block of 16 digits from collapsing
        before, now = q, (image - edge * q) / edge
        for _ in range(steps - 1):
            size = np.linalg.norm(now, axis=0)  # each column may be scaled as long as both terms are
            before, now = before / size, now / size
            before, now = now, 2 * (product(now) - edge * now) / edge - before
            passes += 1
        q = np.linalg.qr(now)[0]


def fit_whitening(fit: DataFrame, dims: int, components: int, **how) -> Fit | None:
    """Fits the components to a table of distinct vectors of longs in column x; None if there is none."""
    n, sums = _totals(fit, dims)
    if not n or not dims:
        return None
    out = Fit(n, sums, np.zeros((dims, 0)), np.zeros(0), 0.0)
    mean = out.mean

    def product(q: np.ndarray) -> np.ndarray:
        got = _pass(fit, mean, q, n)
        out.trace = float(got[0, -1])
        return got[:, :-1]

    vectors, values, out.residual, out.passes = subspace_iteration(product, dims, components, **how)
    rank = int((values > 1e-12 * max(values[0], 1e-300)).sum())  # directions without variance can't be whitened
    out.vectors, out.values = vectors[:, :rank], values[:rank]
    if rank:
        weights = out.vectors / np.sqrt(out.values)

        def squares(column: pa.ListArray) -> np.ndarray:
            w = (_matrix(column, dims) - mean) @ weights
            return w.T @ w

        out.identity_error = float(np.abs(_summed(fit, squares, rank, rank) / n - np.eye(rank)).max())
    return out


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2 for each row, exact; None where it exceeds a long."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if n * most < 1 << 61 and max(map(abs, sums)) < 1 << 61:
        d = n * x - np.array(sums, np.int64)
        if x.shape[1] * int(np.abs(d).max(initial=0)) ** 2 < 1 << 62:
            return (d * d).sum(axis=1).tolist()
    whole = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in whole]


def _apply(fit: Fit, dims: int):
    mean, weights, rank = fit.mean, fit.vectors / np.sqrt(fit.values), len(fit.values)
    explained = fit.values / fit.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                x, rows = _matrix(batch.column(1), dims), batch.num_rows
                of = pa.array(np.repeat(np.arange(rows), rank))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(of),
                        pa.array(np.tile(np.arange(1, rank + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * rank, fit.n, np.int64)),
                        pa.array(_deviations(x, fit.n, fit.sums), pa.int64()).take(of),
                        pa.array(((x - mean) @ weights).ravel()),
                        pa.array(np.tile(explained, rows)),
                        pa.array(np.full(rows * rank, fit.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whiten(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, **how) -> DataFrame:
    """A row per whole vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold a null or non-finite entry go.  Shorter vectors than the longest are filled up with zeros.  The fit
    list has each vector of longs once, so copies don't weigh, but each gets its rows; null ids stay.  Components without variance
    (under 1e-12 of the largest) are left out: a table of equal vectors, or of empty ones, gives no rows, and so does an empty table.
    A deviation that exceeds a long is null.  Tied eigenvalues get some orthonormal basis of their space, the same for all rows.
    Only sums by dimension and blocks of dimensions by (1 + oversample) * components reach the driver.
    """
    empty = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = rows.sparkSession
    whole = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(_is_whole(F.col("v")))
    dims = whole.agg(F.max(F.size("v"))).first()[0] or 0
    levels = whole.select("vec_id", _levels(F.col("v"), dims).alias("x"))
    fit = materialize(levels.select("x").distinct(), workspace(spark, "whitening")) if dims else None
    found = fit_whitening(fit, dims, components, **how) if dims else None
    if found is None or not len(found.values):
        return spark.createDataFrame([], empty)
    return levels.mapInArrow(_apply(found, dims), empty)
