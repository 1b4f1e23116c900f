"""Embedding whitening: exact sums, a distributed centred scatter, cyclic Jacobi rotations on the driver, a broadcast matrix."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scale and offset of the integers that stand for entries.
SCALE, OFFSET = 64, 1_000_000
#: Components that are returned of each vector.
COMPONENTS = 32
#: Dimensions up to which a matrix (8 bytes for each pair) goes to the driver, and lengths of vectors in one table.
DIMENSIONS, LENGTHS = 4096, 64
_SAFE = 2**62


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix by cyclic Jacobi rotations.

    A sweep rotates every pair of dimensions once, in rounds of disjoint pairs as in a tournament. It ends when each
    entry off the diagonal is negligible beside the two diagonal entries of its row and column, which is what keeps
    small eigenvalues accurate.
    """
    a = np.array(matrix, dtype=np.float64)
    d = len(a)
    v = np.eye(d)
    seats = list(range(d + d % 2))  # an odd one out rests beside seat d
    for _ in range(sweeps):
        diagonal = np.abs(np.diag(a))
        off = np.abs(a - np.diag(np.diag(a)))
        if (off <= np.finfo(float).eps * 0.5 * np.sqrt(np.outer(diagonal, diagonal))).all():
            break
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            p, q = np.array(seats[:half]), np.array(seats[half:][::-1])
            p, q = np.minimum(p, q)[(p < d) & (q < d)], np.maximum(p, q)[(p < d) & (q < d)]
            app, aqq, apq = a[p, p], a[q, q], a[p, q]
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                theta = (aqq - app) / (2 * apq)
                t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.sqrt(theta * theta + 1))
            t = np.where(apq == 0, 0.0, t)
            c = 1 / np.sqrt(t * t + 1)
            s = t * c
            rows_p, rows_q = a[p], a[q]
            a[p], a[q] = c[:, None] * rows_p - s[:, None] * rows_q, s[:, None] * rows_p + c[:, None] * rows_q
            columns_p, columns_q = a[:, p], a[:, q]
            a[:, p], a[:, q] = columns_p * c - columns_q * s, columns_p * s + columns_q * c
            a[p, q] = a[q, p] = 0.0
            a[p, p], a[q, q] = app - t * apq, aqq + t * apq
            columns_p, columns_q = v[:, p], v[:, q]
            v[:, p], v[:, q] = columns_p * c - columns_q * s, columns_p * s + columns_q * c
            seats = [seats[0], seats[-1], *seats[1:-1]]
    values = np.diag(a).copy()
    order = np.argsort(-values, kind="stable")
    return values[order], v[:, order]


@dataclass(frozen=True)
class Model:
    """What whitens vectors of one length: n, exact sums, mean, columns of the whitening matrix (nan: no variance), shares of variance."""

    n: int
    sums: tuple[int, ...]
    mean: np.ndarray
    matrix: np.ndarray
    explained: np.ndarray


def entries(vector: Column) -> Column:
    """The integers x of a vector; null if it is null, or holds a null, non-finite or unrepresentable entry."""
    wide = vector.cast("array<double>")
    fits = F.forall(wide, lambda c: F.coalesce((F.abs(c * SCALE) < float(_SAFE)) & ~F.isnan(c), F.lit(False)))
    return F.when(fits, F.transform(wide, lambda c: F.floor(c * SCALE).cast("long") + OFFSET))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, np.ndarray]]:
    """Length, ids and integers of the vectors of each batch, one length at a time."""
    for batch in batches:
        x = batch.column("x")
        sizes, flat, starts = x.value_lengths().to_numpy(), x.flatten().to_numpy(zero_copy_only=False), None
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            yield int(size), at, flat[starts[at][:, None] + np.arange(size)].reshape(len(at), size)


def _centred(model: Model, x: np.ndarray) -> np.ndarray:
    """x - S/n in double precision, the integers subtracted first."""
    whole = np.array([s // model.n for s in model.sums], dtype=np.int64)
    part = np.array([(s % model.n) / model.n for s in model.sums])
    return (x - whole).astype(np.float64) - part


def _second_moments(rows: DataFrame, of: Callable[[int, np.ndarray], np.ndarray | None]) -> dict[int, np.ndarray]:
    """For each length the sum over vectors of the outer product of of(length, x)'s rows with themselves, by Spark's own sum of the tasks' matrices."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for size, _, x in _matrices(batches):
            w = of(size, x)
            sums[size] = sums.get(size, 0) + w.T @ w
        for size, found in sums.items():
            i, j = np.tril_indices(len(found))
            for at in range(0, len(i), 100_000):
                few = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i[few]), size, np.int32)), pa.array(i[few].astype(np.int32)), pa.array(j[few].astype(np.int32)), pa.array(found[i[few], j[few]])], ["size", "i", "j", "v"])

    out: dict[int, np.ndarray] = {}
    for size, i, j, v in rows.mapInArrow(partial, "size int, i int, j int, v double").groupBy("size", "i", "j").agg(F.sum("v").alias("v")).toPandas().itertuples(index=False):
        if size not in out:
            out[size] = np.zeros((1, 1))
        if i >= len(out[size]):
            out[size] = np.pad(out[size], (0, i + 1 - len(out[size])))
        out[size][i, j] = out[size][j, i] = v
    return out


def fit(rows: DataFrame) -> dict[int, Model]:
    """A model for each length of x: exact sums in one pass, the centred scatter in a second, Jacobi rotations on the driver."""
    totals = rows.select(F.size("x").alias("size"), F.posexplode("x").alias("i", "v")).groupBy("size", "i").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    sizes = [r.size for r in rows.select(F.size("x").alias("size")).where("size > 0").distinct().limit(LENGTHS + 1).collect()]
    if len(sizes) > LENGTHS or max(sizes, default=0) > DIMENSIONS:
        raise ValueError(f"vectors have more than {LENGTHS} lengths or {DIMENSIONS} dimensions")
    sums: dict[int, dict[int, tuple[int, int]]] = defaultdict(dict)
    for r in totals.collect():
        sums[r.size][r.i] = r.n, int(r.s)
    start = {size: Model(of[0][0], tuple(of[i][1] for i in range(size)), np.zeros(0), np.zeros((0, 0)), np.zeros(0)) for size, of in sums.items()}
    shared = rows.sparkSession.sparkContext.broadcast(start)
    scatter = _second_moments(rows, lambda size, x: _centred(shared.value[size], x))
    out = {}
    for size, model in start.items():
        values, vectors = jacobi(scatter[size] / model.n)
        few = min(COMPONENTS, size)
        real = values[:few] > np.finfo(float).eps * size * max(values[0], 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            matrix = np.where(real, vectors[:, :few] / np.sqrt(np.where(real, values[:few], 1)), np.nan)
            explained = np.where(real, values[:few], 0) / values.sum() if values.sum() > 0 else np.zeros(few)
        out[size] = Model(model.n, model.sums, np.array([s / model.n for s in model.sums]), matrix, explained)
    return out


def _deviations(model: Model, x: np.ndarray) -> list[int | None]:
    """Exact sums of (n x - S)^2; null beyond a long."""
    n, s = model.n, model.sums
    reach = max(abs(int(x.min())), abs(int(x.max())), 1) * n + max(map(abs, s))
    if reach < 2**31 or reach < _SAFE and (bound := float(np.abs(n * x - np.array(s, dtype=np.int64)).max())) ** 2 * len(s) < _SAFE:
        y = n * x - np.array(s, dtype=np.int64)
        return (y * y).sum(axis=1).tolist()
    exact = [sum((n * int(e) - t) ** 2 for e, t in zip(row, s, strict=True)) for row in x]
    return [e if e < 2**63 else None for e in exact]


def whitened(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every fit vector and component up to COMPONENTS.

    Vectors that are null, or hold a null, non-finite or too large an entry (64 times it beyond a long), and empty
    ones are left out. Repeated rows count and return as often as they stand; a null vec_id stays null; other
    columns are ignored; an empty table gives an empty result. Vectors of another length are whitened among
    themselves, with an n, components and an identity_error of their own. A component without variance (an
    eigenvalue within rounding of zero) has whitened null and explained 0, and doesn't enter identity_error; a
    deviation beyond a long is null.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), entries(F.col(vector)).alias("x")).where("x is not null and size(x) > 0")
    models = fit(rows)
    context = vectors.sparkSession.sparkContext
    shared = context.broadcast(models)

    def projected(size: int, x: np.ndarray) -> np.ndarray:
        model = shared.value[size]
        w = _centred(model, x) @ np.nan_to_num(model.matrix)
        return np.hstack([np.ones((len(w), 1)), w])

    errors = {}
    for size, sums in _second_moments(rows, projected).items():
        real = ~np.isnan(models[size].matrix).any(axis=0)
        mean = sums[0, 1:] / sums[0, 0]
        covariance = (sums[1:, 1:] / sums[0, 0] - np.outer(mean, mean))[np.ix_(real, real)]
        errors[size] = float(np.abs(covariance - np.eye(len(covariance))).max()) if real.any() else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for size, at, x in _matrices([whole]):
                model = shared.value[size]
                w = _centred(model, x) @ model.matrix
                rows, few = w.shape
                numbers = np.repeat(np.arange(rows), few)
                ids = whole.column("vec_id").take(pa.array(at)).take(pa.array(numbers))
                deviation = pa.array(_deviations(model, x), pa.int64()).take(pa.array(numbers))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(np.tile(np.arange(1, few + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * few, model.n, np.int64)),
                        deviation,
                        pa.array(w.ravel(), from_pandas=True),
                        pa.array(np.tile(model.explained, rows)),
                        pa.array(np.full(rows * few, errors[size])),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
