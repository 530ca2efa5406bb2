"""Embedding whitening: principal components by blockwise TSQR and one-sided Jacobi.

Components become integers, so that counts, sums and deviations are exact.  A
task centres its rows and folds them, block by block, into one upper triangle R
with the same inner products (a QR step of R stacked on the block).  The
triangles of all tasks are folded in a tree of such steps; each step streams, so
a task holds two triangles and one block whatever the input.  The last triangle
has the dimension's size.  Plane rotations make its columns orthogonal: their
lengths are the standard deviations times the root of n, without ever squaring
the data, and the rotations multiplied up are the components.

Passes over the vectors: sums; triangles; the covariance of what whitening gives,
for the identity error; the result.  Only sums, one triangle and one small
covariance reach the driver.

Defined cases: rows whose vector is null or empty, or holds null or non-finite
entries, take no part; the dimension is the length that most remaining rows
have (of equals the least), and rows of any other length take no part; integers
beyond a long's range count as its ends, and a deviation that a long can't hold
is null; repeated rows and null ids count like others; directions without
variance (a constant dimension, fewer rows than dimensions) have no component,
so a single row or equal rows give no row; an empty table gives no row; equal
eigenvalues leave the choice of axes free; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import small_batches, table
from .codes import LONG, finite, integers

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
#: tasks of the last but one level of a tree
FAN_IN = 32
#: rows of a block
BLOCK = 2048
SWEEPS = 60


def _longs(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.minimum(integers(flat, SCALE), LONG - SHIFT).reshape(len(column), dim) + SHIFT


class Fit:
    """Exact count and sums, and what is derived from them."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([(s % n) / n for s in sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the whole part on integers, so nothing is lost to a large mean."""
        safe = np.abs(x) < 2**62
        exact = np.where(safe, x - self.whole, 0).astype(np.float64)
        return np.where(safe, exact, x.astype(np.float64) - self.whole) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - S) squared."""
        most = float(self.n) * float(np.abs(x).max(initial=0)) + max(map(abs, self.sums))
        if most < 2**60 and float(np.abs(self.centred(x)).max(initial=0) * self.n + 1) ** 2 * x.shape[1] < 2**62:
            off = x * self.n - np.array(self.sums, np.int64)
            return (off * off).sum(1).tolist()
        off = x.astype(object) * self.n - np.array(self.sums, object)
        return [v if v <= LONG else None for v in (off * off).sum(1).tolist()]


def _fit(rows: DataFrame, dim: int) -> Fit:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, object)
        for batch in batches:
            x = _longs(batch.column(0), dim)
            n += len(x)
            total += (x if np.abs(x).max(initial=0) < 2**40 else x.astype(object)).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *[pa.array([Decimal(int(s))], pa.decimal128(38, 0)) for s in total]], names=["n", *(f"s{i}" for i in range(dim))])

    schema = "n long, " + ", ".join(f"s{i} decimal(38,0)" for i in range(dim))
    one = rows.select("v").mapInArrow(sums, schema).agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(dim)]).first()
    return Fit(int(one["n"]), [int(one[f"s{i}"]) for i in range(dim)])


def _folded(parts: DataFrame, fold, schema: str) -> list:
    """Rows (place, m), one of each task, folded in a tree: by as many tasks as
    their size asks for, then by FAN_IN, then by one."""
    parts = parts.repartition("place").mapInArrow(fold, schema)
    return parts.repartition(FAN_IN, "place").mapInArrow(fold, schema).repartition(1).mapInArrow(fold, schema).collect()


def _rows(m: np.ndarray, place: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))], names=["place", "m"])


def _triangle(rows: DataFrame, fit: Fit, dim: int) -> np.ndarray:
    """R of all centred rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, held, n = np.zeros((0, dim)), [], 0
        for batch in batches:
            held.append(fit.centred(_longs(batch.column(0), dim)))
            n += len(held[-1])
            if n >= BLOCK:
                r, held, n = np.linalg.qr(np.vstack([r, *held]), mode="r"), [], 0
        if held:
            r = np.linalg.qr(np.vstack([r, *held]), mode="r")
        if len(r):
            yield _rows(r, TaskContext.get().partitionId())

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dim))
        for batch in batches:
            for i in range(batch.num_rows):
                m = batch.column(1).slice(i, 1).flatten().to_numpy().reshape(-1, dim)
                r = np.linalg.qr(np.vstack([r, m]), mode="r")
        if len(r):
            yield _rows(r, TaskContext.get().partitionId())

    schema = "place int, m array<double>"
    last = _folded(rows.select("v").mapInArrow(task, schema), fold, schema)
    return np.array(last[0]["m"]).reshape(-1, dim)


def one_sided_jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values in falling order and right singular vectors (as columns):
    rounds of disjoint column pairs are rotated until all are orthogonal to
    working precision."""
    dim = r.shape[1]
    size = dim + dim % 2
    a, v = np.zeros((max(len(r), 1), size)), np.eye(size)
    a[: len(r), :dim] = r
    ring = np.arange(size)
    for _ in range(SWEEPS):
        rotated = False
        for _ in range(size - 1):
            p, q = ring[: size // 2], ring[size // 2 :][::-1]
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            turn = np.abs(gamma) > size * np.finfo(float).eps * np.sqrt(alpha * beta)
            if turn.any():
                rotated = True
                with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                    zeta = (beta - alpha) / (2 * gamma)
                    t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                t = np.where(turn, t, 0.0)
                c = 1 / np.hypot(1.0, t)
                s = c * t
                for m in (a, v):
                    x, y = m[:, p].copy(), m[:, q].copy()
                    m[:, p], m[:, q] = c * x - s * y, s * x + c * y
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if not rotated:
            break
    a, v = a[:, :dim], v[:dim, :dim]
    lengths = np.sqrt((a * a).sum(0))
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], v[:, order]


def _identity_error(rows: DataFrame, fit: Fit, axes: np.ndarray, dim: int) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity.
    A task's covariance is about its own mean, and two are joined about theirs."""
    k = axes.shape[1]

    def joined(one, two):
        (n, mean, m), (n2, mean2, m2) = one, two
        if not n:
            return two
        apart, total = mean2 - mean, n + n2
        return total, mean + apart * (n2 / total), m + m2 + np.outer(apart, apart) * (n * n2 / total)

    none = (0.0, np.zeros(k), np.zeros((k, k)))
    flat = lambda x: np.concatenate([[x[0]], x[1], x[2].ravel()])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = none
        for batch in batches:
            w = fit.centred(_longs(batch.column(0), dim)) @ axes
            if len(w):
                mean = w.mean(0)
                held = joined(held, (float(len(w)), mean, (w - mean).T @ (w - mean)))
        if held[0]:
            yield _rows(flat(held), TaskContext.get().partitionId())

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = none
        for batch in batches:
            for i in range(batch.num_rows):
                m = batch.column(1).slice(i, 1).flatten().to_numpy()
                held = joined(held, (float(m[0]), m[1 : k + 1], m[k + 1 :].reshape(k, k)))
        if held[0]:
            yield _rows(flat(held), TaskContext.get().partitionId())

    schema = "place int, m array<double>"
    last = _folded(rows.select("v").mapInArrow(task, schema), fold, schema)
    m = np.array(last[0]["m"])
    return float(np.abs(m[k + 1 :].reshape(k, k) / m[0] - np.eye(k)).max())


def whitened(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), one row
    for each vector and component with variance, at most ``components``."""
    small_batches(vectors.sparkSession)
    rows = vectors.where(finite(F.col(column))).select(F.col(key).alias("id"), F.col(column).alias("v"))
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").head()
    if common is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dim = common["dim"]
    rows = rows.where(F.size("v") == dim)
    fit = _fit(rows, dim)
    r = _triangle(rows, fit, dim)
    lengths, axes = one_sided_jacobi(r)
    # what is left of rounding is no variance
    noise = 8 * dim * np.finfo(float).eps * lengths[0]
    k = min(components, int((lengths > noise).sum()))
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    explained = lengths[:k] ** 2 / (r * r).sum()
    axes = axes[:, :k] / (lengths[:k] / np.sqrt(fit.n))
    error = _identity_error(rows, fit, axes, dim)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _longs(batch.column("v"), dim)
            w = fit.centred(x) @ axes
            every = np.repeat(np.arange(len(x)), k)
            cells = [
                batch.column("id").take(pa.array(every)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(every), fit.n)),
                pa.array(fit.deviations(x), pa.int64()).take(pa.array(every)),
                pa.array(w.ravel()),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(every), error)),
            ]
            yield pa.RecordBatch.from_arrays(cells, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(out, schema)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings", "vec_id", "embedding")).withColumnRenamed("id", "vec_id")
