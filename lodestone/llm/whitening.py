"""Operator 13: whitening of embeddings by cyclic Jacobi rotations.

Vectors are quantised to whole numbers x.  The fit list has each distinct x once.
Its scatter is gathered by Spark tasks, centred before it is multiplied: at the
whole numbers next to the means, so that every partial sum is an exact whole
number and neither the order of tasks nor a rerun changes one bit.  The driver
gets one number a pair of dimensions, takes off what rounding the centre added,
also exactly, and divides once: V is the covariance of the fit list, correctly
rounded.

Eigenvectors are made by cyclic Jacobi: a sweep rotates every pair of dimensions
once, in the order of a round-robin tournament, whose rounds hold pairs without a
dimension in common.  Sweeps end when each off-diagonal entry is below one unit of
rounding of the geometric mean of its two diagonal entries; by that rule small
eigenvalues are as accurate relative to themselves as large ones.  The sorted
vectors over the roots of their values are the whitening matrix, which goes to
the tasks with their function (dimensions x components numbers).

Defined results: rows whose vector is null or has a null or non-finite entry are
left out; a shorter vector counts as filled up with zeros; repeated rows and null
ids stay, each row gets its own results; a component without variance (below
``NO_VARIANCE`` of the trace) has null ``whitened`` and takes no part in
``identity_error``; a deviation that does not fit a long is null; an empty table
gives an empty result; there are as many components as dimensions at most.  Only
the id and the vector are read.  ``MAX_DIMS`` bounds what the driver holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialize
from lodestone.llm.vectors import EXACT, in_batches, matrix, usable

COMPONENTS = 4
#: Dimensions that a fit takes: the driver holds a few matrices of MAX_DIMS x MAX_DIMS numbers.
MAX_DIMS = 2048
BLOCK_ROWS = 4096
SWEEPS = 60
NO_VARIANCE = 1e-14
_SUM = "i int, j int, v decimal(38,0)"


def products(z: np.ndarray) -> np.ndarray:
    """z' z of whole numbers, exact: in doubles where these hold every sum, else in Python's numbers."""
    largest = int(np.abs(z).max(initial=0))
    if largest * largest * max(1, len(z)) < EXACT:
        half = z.astype(np.float64)
        return (half.T @ half).astype(np.int64).astype(object)
    return z.astype(object).T @ z.astype(object)


def _sums(fit: DataFrame, dims: int, centre: np.ndarray | None) -> dict[tuple[int, int], int]:
    """(-1, -1): rows; (i, -1): sum of dimension i; with a centre also (i, j), j <= i: sum of products; of x less the centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first = 0, np.zeros(dims, object)
        second = np.zeros((dims, dims), object) if centre is not None else None
        for batch in in_batches(batches, BLOCK_ROWS):
            z = matrix(batch.column(0), dims)
            z = z if centre is None else z - centre
            n += len(z)
            first = first + z.sum(axis=0).astype(object)
            if second is not None:
                second = second + products(z)
        if n:
            own = [(-1, -1, n), *((i, -1, v) for i, v in enumerate(first))]
            if second is not None:
                own += [(i, j, second[i, j]) for i in range(dims) for j in range(i + 1)]
            i, j, v = zip(*own, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(x)) for x in v], pa.decimal128(38, 0))], ["i", "j", "v"])

    rows = fit.select("x").mapInArrow(run, _SUM).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    return {(r.i, r.j): int(r.v) for r in rows}


def _rotate(a: np.ndarray, u: np.ndarray, p: np.ndarray, q: np.ndarray, floor: float) -> int:
    """Rotates the pairs (p, q), which have no dimension in common, where that changes anything; how many."""
    off = np.abs(a[p, q])
    need = (off > np.finfo(float).eps * np.sqrt(np.abs(a[p, p] * a[q, q]))) & (off > floor)
    p, q = p[need], q[need]
    if len(p):
        with np.errstate(over="ignore"):
            theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
            t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(1, theta))
        c = 1 / np.hypot(1, t)
        s = t * c
        change = t * a[p, q]
        on_p, on_q = a[p, p] - change, a[q, q] + change
        for m in (a, u):
            m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
        a[p], a[q] = c[:, None] * a[p] - s[:, None] * a[q], s[:, None] * a[p] + c[:, None] * a[q]
        a[p, q] = a[q, p] = 0
        a[p, p], a[q, q] = on_p, on_q
    return len(p)


def jacobi(symmetric: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix."""
    a = np.array(symmetric, np.float64)
    dims = len(a)
    u = np.eye(dims)
    seats = list(range(dims + dims % 2))
    half = len(seats) // 2
    floor = np.finfo(float).eps ** 2 * np.abs(np.diag(a)).max(initial=0)
    for _ in range(SWEEPS):
        rotated = 0
        for _ in range(len(seats) - 1):
            p, q = np.array(seats[:half]), np.array(seats[half:][::-1])
            both = (p < dims) & (q < dims)
            rotated += _rotate(a, u, p[both], q[both], floor)
            seats = [seats[0], seats[-1], *seats[1:-1]]
        if not rotated:
            break
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    return values[order], u[:, order]


@dataclass(frozen=True)
class Whitening:
    """A fit: rows and sums of the fit list, trace of V, eigenvalues (falling) and eigenvectors (columns)."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    @property
    def dims(self) -> int:
        return len(self.sums)

    def whitened(self, x: np.ndarray, components: int) -> np.ndarray:
        """x, centred, on the first components, each over the root of its variance; NaN without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.values > NO_VARIANCE * self.trace, 1 / np.sqrt(self.values), np.nan)[:components]
        return ((x - np.array([s / self.n for s in self.sums])) @ self.vectors[:, :components]) * scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - sums)^2, exact; None where a long cannot hold it."""
        # No whole-number step below overflows if this bound, in Python's numbers, is in range.
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if most * most * max(1, self.dims) < 1 << 63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in exact]


def fit_whitening(fit: DataFrame) -> Whitening | None:
    """The fit of distinct vectors ``x``; None if there are none, or none with a component."""
    dims = fit.agg(F.max(F.size("x"))).first()[0] or 0
    if dims > MAX_DIMS:
        raise ValueError(f"Vectors have {dims} dimensions; a fit takes {MAX_DIMS} at most.")
    if not dims:
        return None
    plain = _sums(fit, dims, None)
    n, sums = plain[-1, -1], [plain[i, -1] for i in range(dims)]
    # The whole number next to each mean.
    centre = [(2 * s + n) // (2 * n) for s in sums]
    around = _sums(fit, dims, np.array(centre, np.int64))
    first = [s - n * m for s, m in zip(sums, centre, strict=True)]
    v = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i + 1):
            v[i, j] = v[j, i] = (n * around[i, j] - first[i] * first[j]) / (n * n)
    values, vectors = jacobi(v)
    return Whitening(n, tuple(sums), float(np.trace(v)), values, vectors)


def identity_error(fit: DataFrame, model: Whitening, components: int) -> float:
    """The largest absolute entry of the covariance of the whitened fit list, less the identity."""
    k = min(components, model.dims)

    def gathered(centre: np.ndarray | None) -> dict[tuple[int, int], float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k if centre is None else (k, k))
            for batch in in_batches(batches, BLOCK_ROWS):
                w = np.nan_to_num(model.whitened(matrix(batch.column(0), model.dims), k))
                total = total + (w.sum(axis=0) if centre is None else (w - centre).T @ (w - centre))
            i, j = np.indices(np.atleast_2d(total).shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.reshape(-1))], ["i", "j", "v"])

        rows = fit.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
        return {(r.i, r.j): r.v / model.n for r in rows}

    means = gathered(None)
    cov = gathered(np.array([means[0, i] for i in range(k)]))
    known = [i for i in range(k) if model.values[i] > NO_VARIANCE * model.trace]
    return max((abs(cov[i, j] - (i == j)) for i in known for j in known), default=0.0)


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = COMPONENTS, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """A row for each usable row and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    own = usable(rows, F.col(vec_id).cast("long").alias("vec_id"), vector=vector)
    fit = materialize(own.select("x").distinct(), "whitening-fit")
    model = fit_whitening(fit)
    if model is None:
        return rows.sparkSession.createDataFrame([], _OUT)
    k = min(components, model.dims)
    error = identity_error(fit, model, k)
    explained = np.maximum(model.values[:k], 0) / model.trace if model.trace > 0 else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches, BLOCK_ROWS):
            x = matrix(batch.column(1), model.dims)
            m = len(x)
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)),
                    pa.array(model.deviations(x), pa.int64()).take(pa.array(each)),
                    pa.array(model.whitened(x, k).reshape(-1), from_pandas=True),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return own.mapInArrow(run, _OUT)
