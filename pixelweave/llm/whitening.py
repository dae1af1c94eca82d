"""Embedding whitening: Welford updates in partition iterators, merged by the parallel update formula, symmetric QR eigen-solve.

Each entry c becomes the integer x = floor(64 c) + 1,000,000. A task folds its vectors one by one into a count, means and
a matrix of centred products (a rank-one update each); the states of all tasks are merged in rounds of bounded fan-in by
the parallel update formula, so that neither a task nor the driver holds more than a few states at any number of
partitions. The last state is solved by Householder reduction to a tridiagonal matrix and implicit symmetric QR steps.
Memory grows with the square of the dimension alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SCALE, SHIFT = 64.0, 1_000_000
COMPONENTS = 32
#: Bytes of states that a merging task reads one after another; their number is between 2 and 64.
MERGE_BYTES, MOST_STATES = 1 << 28, 64
#: Entries stop here as integers, so that any finite entry has one (floats reach further than 64 bits).
MOST_ENTRY = 1 << 61
LONG = 1 << 63


class Moments:
    """Count, exact integer sums, means and centred products of vectors; the products are of doubles."""

    def __init__(self, d: int):
        self.n, self.sums, self.mean, self.products = 0, np.zeros(d, object), np.zeros(d), np.zeros((d, d))

    def add(self, x: np.ndarray) -> None:
        """One Welford update for each row of integers: the mean moves by a share of the distance, the products by a rank-one matrix."""
        high, low = x >> 32, x & 0xFFFFFFFF
        self.sums = self.sums + (high.sum(0).astype(object) << 32) + low.sum(0).astype(object)
        mean, products, outer = self.mean, self.products, np.empty_like(self.products)
        for row in x.astype(np.float64):
            self.n += 1
            delta = row - mean
            mean += delta / self.n
            np.multiply.outer(delta, row - mean, out=outer)
            products += outer

    def merge(self, n: int, sums: list[int], mean: np.ndarray, products: np.ndarray) -> None:
        """The parallel update: both products and a rank-one matrix of the distance of the means."""
        if not n:
            return
        both = self.n + n
        delta = mean - self.mean
        self.products += products + np.multiply.outer(delta, delta) * (self.n * (n / both))
        self.mean += delta * (n / both)
        self.n, self.sums = both, self.sums + np.array(sums, object)

    def merge_row(self, batch: pa.RecordBatch, i: int) -> None:
        n, sums, mean, products = (batch.column(c)[i].as_py() for c in STATE_NAMES[1:])
        self.merge(n, [int(s) for s in sums], np.frombuffer(mean), np.frombuffer(products).reshape(self.products.shape))

    def covariance(self) -> np.ndarray:
        return (self.products + self.products.T) / (2 * max(self.n, 1))

    def row(self, at: int) -> pa.RecordBatch:
        values = [[at], [self.n], [[str(s) for s in self.sums]], [self.mean.tobytes()], [self.products.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, STATE_TYPES, strict=True)], names=STATE_NAMES)


STATE_NAMES = ["at", "n", "sums", "mean", "products"]
STATE_TYPES = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary()]
STATE = "at long, n long, sums array<string>, mean binary, products binary"


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, Q) with Q^T A Q tridiagonal, by Householder reflections of the columns."""
    a, d = matrix.copy(), len(matrix)
    q = np.eye(d)
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, :] -= 2 * np.outer(v, v @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a symmetric matrix, by falling eigenvalue.

    Implicit QR steps with Wilkinson's shift chase a bulge of Givens rotations down the unreduced end of the tridiagonal
    matrix until its last off-diagonal entry vanishes beside its neighbours.
    """
    diagonal, off, q = tridiagonal(matrix)
    rows = np.ascontiguousarray(q.T)
    a, b = diagonal.tolist(), off.tolist()
    end = len(a) - 1
    tiny = np.finfo(np.float64).eps
    while end > 0:
        if abs(b[end - 1]) <= tiny * (abs(a[end - 1]) + abs(a[end])):
            b[end - 1] = 0.0
            end -= 1
            continue
        start = end - 1
        while start > 0 and abs(b[start - 1]) > tiny * (abs(a[start - 1]) + abs(a[start])):
            start -= 1
        half = (a[end - 1] - a[end]) / 2
        square = b[end - 1] ** 2
        shift = a[end] - square / (half + float(np.copysign(np.hypot(half, b[end - 1]), half)))
        x, z = a[start] - shift, b[start]
        for k in range(start, end):
            r = float(np.hypot(x, z))
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > start:
                b[k - 1] = r
            p, w, u = a[k], a[k + 1], b[k]
            a[k] = c * c * p + 2 * c * s * u + s * s * w
            a[k + 1] = s * s * p - 2 * c * s * u + c * c * w
            b[k] = c * s * (w - p) + (c * c - s * s) * u
            if k < end - 1:
                x, z = b[k], s * b[k + 1]
                b[k + 1] = c * b[k + 1]
            one, two = c * rows[k] + s * rows[k + 1], c * rows[k + 1] - s * rows[k]
            rows[k], rows[k + 1] = one, two
    values = np.array(a)
    order = np.argsort(-values, kind="stable")
    return values[order], rows[order].T


@dataclass
class Whitening:
    """What a fit gives: n vectors, their exact sums, the components as columns over sqrt(e), shares of the trace."""

    n: int
    sums: list[int]
    d: int
    scaled: np.ndarray
    explained: list[float]
    identity_error: float = 0.0

    def integers(self, vectors: pa.Array) -> np.ndarray:
        return integers(vectors, self.d)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """x - S/n by components; the integer and the fractional part of S/n are taken off one after the other."""
        whole = np.array([s // max(self.n, 1) for s in self.sums], np.int64)
        rest = np.array([(s % max(self.n, 1)) / max(self.n, 1) for s in self.sums])
        return ((x - whole).astype(np.float64) - rest) @ self.scaled

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None where 64 bits do not hold it."""
        sums = np.array(self.sums, object)
        whole = np.array([s // max(self.n, 1) for s in self.sums], np.int64)
        far = int(np.abs(x - whole).max(initial=0)) + 1
        if (self.n * far) ** 2 * max(self.d, 1) < LONG:
            rest = np.array([s % max(self.n, 1) for s in self.sums], np.int64)
            return (((x - whole) * self.n - rest) ** 2).sum(1).tolist()
        exact = ((x.astype(object) * self.n - sums) ** 2).sum(1)
        return [v if v < LONG else None for v in exact.tolist()]


def integers(vectors: pa.Array, d: int) -> np.ndarray:
    """floor(64 c) + 1,000,000 of each entry."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(vectors), d)
    with np.errstate(over="ignore"):
        scaled = np.clip(np.floor(values * SCALE), -float(MOST_ENTRY), float(MOST_ENTRY))
    return scaled.astype(np.int64) + SHIFT


def _usable(rows: DataFrame, vector: str) -> DataFrame:
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    return rows.where(v.isNotNull() & finite)


def _fold(d: int, vector: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Moments(d)
        for batch in batches:
            if batch.num_rows:
                state.add(integers(batch.column(vector), d))
        yield state.row(TaskContext.get().partitionId())

    return run


def _fold_whitened(model, vector: str, k: int):
    """Counts, means and centred products of the whitened values themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Moments(k)
        for batch in batches:
            if not batch.num_rows:
                continue
            w = model.value.whiten(model.value.integers(batch.column(vector)))
            mean = w.mean(0)
            state.merge(len(w), [0] * k, mean, (w - mean).T @ (w - mean))
        yield state.row(TaskContext.get().partitionId())

    return run


def _merge_tree(states: DataFrame, d: int) -> DataFrame:
    """One state of all, in rounds: each task reads at most ``fan`` states, in the order of their partitions."""
    fan = int(min(MOST_STATES, max(2, MERGE_BYTES // (8 * d * d + 1))))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, Moments(d)
        for batch in batches:
            for i, at in enumerate(batch.column("at").to_pylist()):
                if current is not None and at // fan != current:
                    yield state.row(current)
                    state = Moments(d)
                current = at // fan
                state.merge_row(batch, i)
        if current is not None:
            yield state.row(current)

    states = common.materialize(states, "whitening-states")
    while (last := states.agg(F.max("at").alias("m")).first().m) is not None and last > 0:
        merged = states.repartition(F.floor(F.col("at") / fan)).sortWithinPartitions("at").mapInArrow(one, STATE)
        done, states = states, common.materialize(merged, "whitening-states")
        common.discard(done)
    return states


def _solve(d: int, components: int):
    """The last state as eigenvalues, components over sqrt(e) and the trace; e beside rounding of the largest counts as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            state = Moments(d)
            state.merge_row(batch, 0)
            covariance = state.covariance()
            values, vectors = symmetric_qr(covariance)
            k = min(components, d)
            e = values[:k]
            some = e > max(float(values[0]), 0.0) * d * 1e-14
            scaled = np.where(some, vectors[:, :k] / np.sqrt(np.where(some, e, 1.0)), np.nan)
            trace = float(np.trace(covariance))
            explained = [float(v) / trace if trace > 0 else 0.0 for v in np.where(some, e, 0.0)]
            yield pa.RecordBatch.from_arrays([pa.array([state.n]), pa.array([[str(s) for s in state.sums]]), pa.array([scaled.tobytes()], pa.binary()), pa.array([explained], pa.list_(pa.float64()))], names=["n", "sums", "scaled", "explained"])

    return run


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Fit on all rows whose vector has only finite entries and the most frequent length (ties: the longer).

    The identity error is measured: a second pass whitens every vector and takes the covariance of what comes out. The
    solve runs in a task; of d dimensions and k components the driver gets d (k + 1) numbers.
    """
    spark = rows.sparkSession
    some = _usable(rows.select(F.col(f"`{vector}`").alias("v")), "v")
    length = some.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = length[0].d if length else 0
    k = min(components, d)
    if not d:
        return Whitening(0, [], 0, np.zeros((0, 0)), [])
    some = some.where(F.size("v") == d)
    state = _merge_tree(some.mapInArrow(_fold(d, "v"), STATE), d)
    got = state.mapInArrow(_solve(d, components), "n long, sums array<string>, scaled binary, explained array<double>").first()
    common.discard(state)
    model = Whitening(got.n, [int(s) for s in got.sums], d, np.frombuffer(got.scaled).reshape(d, k), list(got.explained))
    if not any(model.explained):
        return model
    shared = spark.sparkContext.broadcast(model)
    whitened = _merge_tree(some.mapInArrow(_fold_whitened(shared, "v", k), STATE), k)
    got = whitened.first()
    common.discard(whitened)
    kept = np.array(model.explained) > 0
    difference = np.frombuffer(got.products).reshape(k, k) / got.n - np.eye(k)
    model.identity_error = float(np.abs(difference[np.ix_(kept, kept)]).max())
    return model


def transform(rows: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """Rows of the model's length and finite entries, with all their columns, wh_vector array<double> and wh_deviation long.

    wh_vector holds null at components without variance; wh_deviation is null where 64 bits do not hold it. A column of
    ``rows`` named as one of the two gives way to it.
    """
    if not model.d:
        return rows.where("false").drop("wh_vector", "wh_deviation").select("*", F.lit(None).cast("array<double>").alias("wh_vector"), F.lit(None).cast("long").alias("wh_deviation"))
    shared = rows.sparkSession.sparkContext.broadcast(model)
    given = rows.select(common.row_of(rows, ("wh_vector", "wh_deviation")).alias("row"), F.col(f"`{vector}`").alias("v"))
    given = _usable(given, "v").where(F.size("v") == model.d)
    spare = np.array(model.explained) <= 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = shared.value.integers(batch.column("v"))
            w = shared.value.whiten(x)
            values = pa.array(w.ravel(), mask=np.tile(spare, len(w)) if spare.any() else None)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), values)
            yield pa.RecordBatch.from_arrays([batch.column("row"), lists, pa.array(shared.value.deviation(x), pa.int64())], names=["row", "wh_vector", "wh_deviation"])

    schema = given.select("row").schema.add("wh_vector", T.ArrayType(T.DoubleType())).add("wh_deviation", T.LongType())
    return given.mapInArrow(run, schema).select("row.*", "wh_vector", "wh_deviation")


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening]:
    """Fit on ``rows`` and transform them.

    Rows whose vector is null or holds null, NaN or infinite entries are dropped, as are those of another length than most:
    nothing is defined between them and the others. A null id stays, repeated rows are rows each. One vector, or equal
    ones, have no variance: their whitened values are null and explain nothing. Empty tables and empty vectors give no
    rows. Entries beyond 2^61 as integers stop there.
    """
    model = fit(rows, vector, components)
    return transform(rows, model, vector), model
