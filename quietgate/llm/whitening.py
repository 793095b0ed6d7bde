"""Whitening of embeddings by a pivoted Cholesky factor and one-sided Jacobi rotations.

The distinct vectors give exact sums and a centred scatter, both added up task by task. The
scatter's pivoted Cholesky factor L (a triangle under its row permutation) is rotated from the
right until its columns are orthogonal: their squared norms are the scatter's eigenvalues, and
the normalised columns its components. Only sums, one matrix of D by D numbers (D being the
vectors' length) and the components pass through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record, stored

SCALE = 256
COMPONENTS = 4
#: A pivot below this share of the largest one is rounding: the scatter's rank ends there.
_RANK = 1e-13
_SWEEPS = 60
#: Vectors taken into numpy at a time.
_ROWS = 4096
_LONG = float(1 << 63)


def scaled(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id, x``: floor(256 * entry) as longs; rows whose vector is null or holds a null or
    non-finite entry are left out. Raises if a scaled entry is no long."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = vectors.filter(F.col(vector).isNotNull() & ~bad)

    def entry(c):
        y = F.floor(c.cast("double") * SCALE)
        whole = F.floor(c.cast("double") * SCALE / _LONG) == 0
        whole |= F.floor(c.cast("double") * SCALE / _LONG) == -1
        return F.when(whole, y.cast("long")).otherwise(F.raise_error(F.lit("a scaled entry is no long")).cast("long"))

    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(vector, entry).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    """The vectors (column ``x``, all of this length) as rows, some at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.column("x").slice(at, _ROWS)
            yield part.flatten().to_numpy().reshape(len(part), dim)


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L (D by rank) with L L^T = a: after its row permutation, which is undone, a lower triangle.

    Each step takes the largest diagonal entry that is left, and ends where none is above rounding.
    """
    a = a.copy()
    n = len(a)
    order, factor = np.arange(n), np.zeros((n, n))
    top = max(0.0, float(a.diagonal().max(initial=0.0)))
    rank = 0
    for k in range(n):
        pivot = k + int(np.argmax(a.diagonal()[k:]))
        if a[pivot, pivot] <= top * _RANK * n:
            break
        for x in (a, factor):
            x[[k, pivot]] = x[[pivot, k]]
        a[:, [k, pivot]] = a[:, [pivot, k]]
        order[[k, pivot]] = order[[pivot, k]]
        factor[k, k] = math.sqrt(a[k, k])
        factor[k + 1 :, k] = a[k + 1 :, k] / factor[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
        rank = k + 1
    out = np.zeros((n, rank))
    out[order] = factor[:, :rank]
    return out


def jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of factor factor^T, falling, and its unit eigenvectors as columns.

    One-sided rotations make the columns orthogonal. Each round rotates disjoint pairs at once
    (a round-robin of all columns); sweeps go on until no pair needs a rotation.
    """
    work = factor.copy()
    n = work.shape[1]
    players = list(range(n)) + ([-1] if n % 2 else [])
    for _ in range(_SWEEPS):
        turned = False
        ring = players[:]
        for _ in range(len(ring) - 1):
            pairs = [(a, b) for a, b in zip(ring[: len(ring) // 2], ring[::-1]) if a >= 0 and b >= 0]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            p, q = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
            x, y = work[:, p], work[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            need = np.abs(xy) > 1e-15 * np.sqrt(xx * yy)
            if not need.any():
                continue
            turned = True
            p, q, x, y = p[need], q[need], x[:, need], y[:, need]
            zeta = (yy[need] - xx[need]) / (2 * xy[need])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            work[:, p], work[:, q] = c * (x - t * y), c * (t * x + y)
        if not turned:
            break
    norms = np.sqrt((work * work).sum(0))
    order = np.argsort(-norms, kind="stable")
    norms, work = norms[order], work[:, order]
    return norms**2, work / np.where(norms > 0, norms, 1.0)


@dataclass
class Whitening:
    """What is fitted: vectors' length and number, exact sums, eigenvalues, components as columns."""

    dim: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean()) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - S)^2, exactly; None where that is no long."""
        reach = [abs(float(x.max(initial=0))), abs(float(x.min(initial=0))), *[abs(s) / self.n for s in self.sums]]
        if (2.0 * self.n * max(reach)) ** 2 * max(1, self.dim) < _LONG / 2:
            away = self.n * x - np.array(self.sums, np.int64)
            return (away * away).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [e if e < 1 << 63 else None for e in exact]


def _summed_matrix(parts: DataFrame, dim: int) -> np.ndarray:
    """Matrices given as ``i, j, value`` (the lower half) added up."""
    sums = parts.groupBy("i", "j").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros((dim, dim))
    i, j, value = (sums[c].to_numpy() for c in ("i", "j", "value"))
    out[i, j] = value
    out[j, i] = value
    return out


def _lower(matrix: np.ndarray) -> pa.RecordBatch:
    i, j = np.tril_indices(len(matrix))
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("value", pa.float64())])
    return record(schema, (i, j, matrix[i, j]))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Learn from each distinct vector of ``rows`` (from :func:`scaled`) once; None without any.

    Vectors of the length that most rows have take part (the longer one of two as frequent).
    """
    lengths = rows.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    found = lengths.orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not found:
        return None
    dim = found[0]["dim"]
    distinct = stored(rows.filter(F.size("x") == dim).select("x").distinct())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = [0] * dim, 0
        for x in _matrices(batches, dim):
            small = np.abs(x.astype(np.float64)).sum(axis=0).max(initial=0.0) < _LONG / 2
            more = x.sum(axis=0) if small else x.astype(object).sum(axis=0)
            sums, n = [s + int(m) for s, m in zip(sums, more)], n + len(x)
        schema = pa.schema([("i", pa.int32()), ("value", pa.decimal128(38, 0))])
        yield record(schema, (range(-1, dim), [Decimal(v) for v in (n, *sums)]))

    totals = {
        r["i"]: int(r["value"])
        for r in distinct.mapInArrow(add, "i int, value decimal(38,0)").groupBy("i")
        .agg(F.sum("value").cast("decimal(38,0)").alias("value")).collect()
    }
    n, sums = totals[-1], [totals[i] for i in range(dim)]
    mean = np.array([s / n for s in sums])

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for x in _matrices(batches, dim):
            centred = x - mean
            total += centred.T @ centred
        yield _lower(total)

    whole = _summed_matrix(distinct.mapInArrow(scatter, "i int, j int, value double"), dim)
    values, vectors = jacobi(pivoted_cholesky(whole))
    model = Whitening(dim, n, sums, values[:components] / n, vectors[:, :components], float(whole.trace() / n))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(model.values),) * 2)
        for x in _matrices(batches, dim):
            z = model.project(x)
            total += z.T @ z
        yield _lower(total)

    size = len(model.values)
    if not size:
        return model
    got = _summed_matrix(distinct.mapInArrow(spread, "i int, j int, value double"), size) / n
    return replace(model, identity_error=float(np.abs(got - np.eye(size)).max()))


_WHITENED = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double,"
    " identity_error double, eigenvalue double"
)
_WHITENED_TYPES = pa.schema(
    [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
     ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64()),
     ("eigenvalue", pa.float64())]
)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue``.

    One row for each vector that takes part and each of the first ``components`` components of a
    positive eigenvalue: vectors that lie in fewer dimensions have fewer. Repeated rows are
    answered each, null ids stay null. ``deviation`` is null where it is no long. Vectors that
    are null, hold a null or non-finite entry, or are not of the length that most have, take no
    part; without any vector, or with a single distinct one, there is no row.
    """
    spark = vectors.sparkSession
    rows = scaled(vectors)
    model = fit(rows, components)
    if model is None or not len(model.values):
        return spark.createDataFrame([], _WHITENED)
    shared = spark.sparkContext.broadcast(model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        size = len(known.values)
        for batch in batches:
            for at, x in zip(range(0, batch.num_rows, _ROWS), _matrices([batch], known.dim)):
                ids = batch.column("vec_id").slice(at, _ROWS).to_pylist()
                n = len(ids)
                yield record(_WHITENED_TYPES, (
                    [i for i in ids for _ in range(size)], list(range(1, size + 1)) * n, [known.n] * (n * size),
                    [d for d in known.deviations(x) for _ in range(size)], known.project(x).ravel(),
                    np.tile(known.values / known.trace, n), np.full(n * size, known.identity_error),
                    np.tile(known.values, n),
                ))

    return rows.filter(F.size("x") == model.dim).mapInArrow(project, _WHITENED)
