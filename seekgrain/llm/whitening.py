"""Embedding whitening: distributed centred covariance, leading eigenvectors on the driver, broadcast projection.

Entries are put on an integer grid, so sums over the distinct vectors are exact. Every task multiplies its
centred vectors and hands over one partial covariance matrix. The summed matrix, whose size depends on the
number of dimensions only, is brought to tridiagonal form by Householder reflections; its leading
eigenvalues come from bisection on Sturm counts and their vectors from inverse iteration, in which vectors
of close eigenvalues are made orthogonal again. All rows are then projected on the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekgrain.llm.common import giving_back, unused, written

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Grid values are kept within this size, so that the sum of a batch fits into 64 bits.
LARGEST = 1 << 45
#: A component whose eigenvalue is below this share of the trace is rounding noise and is left out.
LEAST_SHARE = 1e-12
#: Eigenvalues nearer than this share of the norm are a cluster: their vectors are made orthogonal again.
CLUSTER = 1e-3
#: Vectors multiplied at once.
BLOCK_ROWS = 4096


def on_grid(vector: Column) -> Column:
    """floor(64 c) + 1000000 of every entry; null where the vector is null, empty or holds null or non-finite entries."""
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))

    def place(c: Column) -> Column:
        wide = F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))
        return F.floor(wide).cast("long") + SHIFT

    return F.when(finite & (F.size(vector) > 0), F.transform(vector, place))


# ---- symmetric eigenproblem -------------------------------------------------------------------------
def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors) of the matrix after Householder reflections from both sides."""
    a = matrix.copy()
    size = len(a)
    off, reflectors = np.zeros(max(size - 1, 0)), []
    for k in range(size - 1):
        column = a[k + 1 :, k].copy()
        alpha = -np.copysign(np.linalg.norm(column), column[0])
        column[0] -= alpha
        length = np.linalg.norm(column)
        off[k] = alpha
        v = column / length if length > 0 else column
        reflectors.append(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = 2 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
    return np.diag(a).copy(), off, reflectors


def counts_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues lie below each number of ``at``."""
    tiny = np.finfo(float).tiny
    squares = np.r_[0.0, off**2]
    count = np.zeros(len(at), np.int64)
    q = np.ones(len(at))
    for d, s in zip(diagonal, squares):
        with np.errstate(over="ignore"):
            q = d - at - s / q
        q = np.where(q == 0, -tiny, q)
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, number: int) -> np.ndarray:
    """The ``number`` largest eigenvalues, falling, by bisection of an interval that holds all of them."""
    radius = np.abs(np.r_[0.0, off]) + np.abs(np.r_[off, 0.0])
    low, high = (diagonal - radius).min(), (diagonal + radius).max()
    room = 1e-12 * max(abs(low), abs(high), np.finfo(float).tiny)
    lows, highs = np.full(number, low - room), np.full(number, high + room)
    wanted = len(diagonal) - np.arange(1, number + 1)  # eigenvalues below the one looked for
    while True:
        middle = lows + (highs - lows) / 2
        if ((middle <= lows) | (middle >= highs)).all():
            return middle
        above = counts_below(diagonal, off, middle) <= wanted
        lows, highs = np.where(above, middle, lows), np.where(above, highs, middle)


def _factored(diagonal: np.ndarray, off: np.ndarray, shift: float, tiny: float):
    """Elimination with row exchange of the shifted tridiagonal matrix, as a function that solves with it."""
    n = len(diagonal)
    main, up, up2 = list(diagonal - shift), [*off, 0.0], [0.0] * n
    swapped, factor = [False] * n, [0.0] * n
    for k in range(n - 1):
        old, below = main[k], off[k]
        if abs(below) > abs(old):
            swapped[k], factor[k] = True, old / below
            main[k], up[k], up2[k], main[k + 1], up[k + 1] = (
                below, main[k + 1], up[k + 1], up[k] - factor[k] * main[k + 1], -factor[k] * up[k + 1],
            )
        else:
            factor[k] = below / (old if abs(old) > tiny else tiny)
            main[k + 1] -= factor[k] * up[k]
    main = [m if abs(m) > tiny else tiny for m in main]

    def solve(b: np.ndarray) -> np.ndarray:
        x = list(b)
        for k in range(n - 1):
            if swapped[k]:
                x[k], x[k + 1] = x[k + 1], x[k]
            x[k + 1] -= factor[k] * x[k]
        for k in range(n - 1, -1, -1):
            rest = x[k]
            if k + 1 < n:
                rest -= up[k] * x[k + 1]
            if k + 2 < n:
                rest -= up2[k] * x[k + 2]
            x[k] = rest / main[k]
        return np.array(x)

    return solve


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of the tridiagonal matrix for falling ``values``."""
    n = len(diagonal)
    norm = max(np.abs(diagonal).max(), np.abs(off).max() if len(off) else 0.0, np.finfo(float).tiny)
    tiny = np.finfo(float).eps * norm
    rng = np.random.default_rng(0)
    vectors = np.zeros((n, len(values)))
    cluster = 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            cluster = k
        # Equal eigenvalues get slightly different shifts.
        solve = _factored(diagonal, off, value - 4 * (k - cluster) * tiny, tiny)
        near = vectors[:, cluster:k]
        v = rng.standard_normal(n)
        for _ in range(5):
            v = v / np.linalg.norm(v)
            v = solve(v)
            v = v / np.abs(v).max()
            for _ in range(2):
                v = v - near @ (near.T @ v)
        vectors[:, k] = v / np.linalg.norm(v)
    return vectors


def leading_components(covariance: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns), falling; the largest entry of a vector is positive.

    Eigenvalues that are rounding noise beside the trace are left out.
    """
    trace = float(np.trace(covariance))
    number = min(number, len(covariance))
    if not trace > 0:
        return np.zeros(0), np.zeros((len(covariance), 0))
    scaled = covariance / trace
    diagonal, off, reflectors = tridiagonal(scaled)
    values = leading_eigenvalues(diagonal, off, number)
    values = values[values > LEAST_SHARE]
    vectors = inverse_iteration(diagonal, off, values)
    for k in range(len(reflectors) - 1, -1, -1):
        v = reflectors[k]
        vectors[k + 1 :] -= 2 * np.outer(v, v @ vectors[k + 1 :])
    vectors /= np.linalg.norm(vectors, axis=0)
    values = np.einsum("ik,ij,jk->k", vectors, scaled, vectors) * trace
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * signs


# ---- distributed sums -------------------------------------------------------------------------------
def _grid_blocks(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    for s in range(0, len(values), BLOCK_ROWS):
        yield values[s : s + BLOCK_ROWS]


def _sums(size: int):
    """(dimension, total, n) of a task's vectors, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, n = [0] * size, 0
        for batch in batches:
            for block in _grid_blocks(batch.column(0), size):
                totals = [t + int(b) for t, b in zip(totals, block.sum(axis=0))]
                n += len(block)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(size), pa.int32()), pa.array(totals, pa.decimal128(38, 0)), pa.array([n] * size, pa.int64())],
                names=["dimension", "total", "n"],
            )

    return giving_back(run)


@dataclass
class Centre:
    """Sums S of n vectors as whole means m and rests r, so that x - S/n is (x - m) - r/n without cancellation."""

    n: int
    sums: list[int]

    def __post_init__(self):
        self.whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        self.rest = [s % self.n for s in self.sums]
        self.part = np.array([r / self.n for r in self.rest])

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.part

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, exact."""
        apart = x - self.whole
        if len(x) and (int(np.abs(apart).max()) + 1) ** 2 * self.n**2 * x.shape[1] < 1 << 63:
            return ((apart * self.n - np.array(self.rest, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        return [sum((self.n * int(a) - r) ** 2 for a, r in zip(row, self.rest)) for row in apart]


def _products(centre: Centre, size: int, projection: np.ndarray | None):
    """(row, products): the upper triangle of the summed outer products of a task's centred, projected vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block in _grid_blocks(batch.column(0), size):
                y = centre.of(block)
                if projection is not None:
                    y = y @ projection
                total = y.T @ y + (0 if total is None else total)
        if total is not None:
            rows = [total[i, i:] for i in range(len(total))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["row", "products"]
            )

    return giving_back(run)


def covariance(grid: DataFrame, centre: Centre, size: int, projection: np.ndarray | None = None) -> np.ndarray:
    """Covariance over the rows of ``grid(x)``, divisor n, centred before multiplying; size x size numbers reach the driver."""
    partial = grid.mapInArrow(_products(centre, size, projection), "row int, products array<double>")
    cells = partial.select("row", F.posexplode("products")).groupBy("row", "pos").agg(F.sum("col").alias("v")).toArrow()
    size = size if projection is None else projection.shape[1]
    i = cells.column("row").to_numpy()
    j = i + cells.column("pos").to_numpy()
    out = np.zeros((size, size))
    out[i, j] = out[j, i] = cells.column("v").to_numpy() / centre.n
    return out


@dataclass
class Whitening:
    """A fitted transform: ``projection`` takes a centred grid vector to its whitened components."""

    size: int
    centre: Centre
    eigenvalues: np.ndarray
    projection: np.ndarray
    explained: np.ndarray
    identity_error: float


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The transform of the distinct grid vectors of ``vectors``; None where no usable vector is left.

    Vectors of another length than the commonest (ties: the longest) have no covariance with the others
    and are left out, as are null and empty ones and those with null or non-finite entries. Entries beyond
    2^39 in size count as that. Repeated vectors count once. The number of components is at most that of
    the dimensions; a single distinct vector has none.
    """
    grid = vectors.select(on_grid(F.col(vector)).alias("x")).filter("x IS NOT NULL")
    lengths = grid.groupBy(F.size("x").alias("length")).count()
    first = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    if first is None:
        return None
    size = first["length"]
    distinct = written(grid.filter(F.size("x") == size).distinct())
    sums = distinct.mapInArrow(_sums(size), "dimension int, total decimal(38,0), n long")
    rows = sums.groupBy("dimension").agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("n").alias("n")).collect()
    centre = Centre(rows[0]["n"], [int(r["total"]) for r in sorted(rows, key=lambda r: r["dimension"])])
    spread = covariance(distinct, centre, size)
    values, directions = leading_components(spread, components)
    projection = directions / np.sqrt(values)
    error = 0.0
    if len(values):
        error = float(np.abs(covariance(distinct, centre, size, projection) - np.eye(len(values))).max())
    return Whitening(size, centre, values, projection, values / max(np.trace(spread), np.finfo(float).tiny), error)


def whiten(
    vectors: DataFrame, model: Whitening | None, vector: str = "embedding", whitened: str = "whitened", deviation: str = "deviation"
) -> DataFrame:
    """The usable rows of ``vectors`` with ``whitened`` array<double> and ``deviation`` decimal, the exact squared distance n^2 |x - S/n|^2.

    Rows that ``fit`` leaves out are left out. Repeated rows each get their line; columns named like the
    results are replaced; an empty table or no model gives no rows.
    """
    kept = vectors.drop(whitened, deviation)
    added = [T.StructField(whitened, T.ArrayType(T.DoubleType())), T.StructField(deviation, T.DecimalType(38, 0))]
    grid = unused(vectors, "_grid")
    rows = kept.withColumn(grid, on_grid(vectors[vector]))
    rows = rows.filter(F.size(grid) == (model.size if model else -2))
    if model is None:
        return rows.drop(grid).withColumns({f.name: F.lit(None).cast(f.dataType) for f in added})
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # size x components numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            at = 0
            last = batch.schema.get_field_index(grid)
            for block in _grid_blocks(batch.column(last), fitted.size):
                part = batch.slice(at, len(block))
                at += len(block)
                values = fitted.centre.of(block) @ fitted.projection
                offsets = np.arange(len(block) + 1, dtype=np.int32) * values.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c for i, c in enumerate(part.columns) if i != last],
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel())),
                        pa.array(fitted.centre.deviation(block), pa.decimal128(38, 0)),
                    ],
                    names=[*[n for n in part.schema.names if n != grid], whitened, deviation],
                )

    return rows.mapInArrow(giving_back(run), T.StructType([*kept.schema.fields, *added]))
