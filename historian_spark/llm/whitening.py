"""Whitening of embeddings by covariances that are merged in a tree.

1. Entries become whole numbers floor(256 * c); equal vectors count once (the fit list, stored).
2. Each partition computes count, exact sums, local mean and centred scatter of its vectors, batch
   by batch. Two such states are merged by Chan's formula, n = a + b, delta = mean_b - mean_a,
   scatter = scatter_a + scatter_b + delta delta' * a * b / n; treeReduce merges them pairwise, so
   the driver gets one state of the square of the dimension, however many vectors there are.
3. eigh on the driver gives components and eigenvalues of scatter / n.
4. A second pass over the fit list whitens it and merges its covariance in the same way: its
   distance from the identity is ``identity_error``.
5. Every row is whitened where it is; nothing but the fit list is moved.

Cases: a vector that is null or holds null, NaN or infinite entries is dropped, and so is one with
an entry that no long holds after times 256; an empty vector has no components, so no rows. Vectors
of several lengths are fitted apart, each length by itself. Repeated rows count once in the fit and
keep a row each in the result; null vec_ids are kept. A component without variance (one vector only,
or all on one line) has no scale: ``whitened`` is null there and it does not count in
``identity_error``; with no variance at all ``explained`` is null as well. ``deviation`` is exact,
null where it does not fit a long. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

COMPONENTS = 4
FLAT = 1e-12  # an eigenvalue below this share of the trace is rounding of a zero
BLOCK = 4096  # vectors that a task centres at once


def fixed_point(rows: DataFrame, vector: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """vec_id and x (array of longs) of the rows that take part."""
    entries = F.col(vector).cast("array<double>")
    scaled = F.transform(entries, lambda c: c * F.lit(256.0))
    fits = F.forall(scaled, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(2.0**63)))
    own = rows.select(F.col(id_column).cast("long").alias("vec_id"), scaled.alias("scaled")).where(F.col("scaled").isNotNull() & fits)
    return own.select("vec_id", F.transform("scaled", lambda c: F.floor(c).cast("long")).alias("x"))


@dataclass
class Moments:
    """Of vectors of one length: how many, their exact sums (if they are whole numbers), mean and centred scatter."""

    n: int
    sums: list[int] | None
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        """Of the rows of a matrix, centred before they are multiplied."""
        exact = None
        if x.dtype == np.int64:
            # halves of 32 bits, so that no sum of a block overflows
            exact = [(int(hi) << 32) + int(lo) for hi, lo in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0))]
            mean = np.array([s / len(x) for s in exact])
        else:
            mean = x.mean(axis=0)
        centred = x - mean
        return cls(len(x), exact, mean, centred.T @ centred)

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        delta = other.mean - self.mean
        sums = None if self.sums is None else [a + b for a, b in zip(self.sums, other.sums)]
        mean = self.mean + delta * (other.n / n) if sums is None else np.array([s / n for s in sums])
        return Moments(n, sums, mean, self.scatter + other.scatter + np.outer(delta, delta) * (self.n * (other.n / n)))

    def packed(self) -> dict:
        return {"n": self.n, "sums": None if self.sums is None else [str(s) for s in self.sums], "mean": self.mean.tolist(), "scatter": self.scatter.ravel().tolist()}

    @classmethod
    def unpacked(cls, row) -> Moments:
        d = len(row["mean"])
        return cls(row["n"], None if row["sums"] is None else [int(s) for s in row["sums"]], np.array(row["mean"]), np.array(row["scatter"]).reshape(d, d))


STATE = "dim int, n long, sums array<string>, mean array<double>, scatter array<double>"


def blocks(lists: pa.Array, keys: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of a column of vectors: key, places, and the matrix of the vectors there; the key is their length if there is no other."""
    ends = np.asarray(lists.offsets)
    flat, sizes, starts = lists.values.to_numpy(zero_copy_only=False), np.diff(ends), ends[:-1]
    keys = sizes if keys is None else keys
    for d in np.unique(keys[sizes > 0]):
        places = np.flatnonzero(keys == d)
        for k in range(0, len(places), BLOCK):
            at = places[k : k + BLOCK]
            yield int(d), at, flat[starts[at][:, None] + np.arange(sizes[at[0]])]


def moments(rows: DataFrame) -> dict[int, Moments]:
    """Moments of vectors v by dim (vectors of one dim are alike in length): a state a partition and dim, merged pairwise in a tree."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Moments] = {}
        for batch in batches:
            for d, _, x in blocks(batch.column("v"), batch.column("dim").to_numpy()):
                own = Moments.of(x)
                found[d] = found[d].merged(own) if d in found else own
        if found:
            yield pa.RecordBatch.from_pylist([{"dim": d} | m.packed() for d, m in found.items()], schema=pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("mean", pa.list_(pa.float64())), ("scatter", pa.list_(pa.float64()))]))

    def merged(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
        return a | {d: a[d].merged(m) if d in a else m for d, m in b.items()}

    states = rows.select("dim", "v").mapInArrow(partial, STATE).rdd.map(lambda r: {r["dim"]: Moments.unpacked(r)})
    states = states.union(rows.sparkSession.sparkContext.parallelize([{}], 1))  # a table may be empty
    return states.treeReduce(merged, max(2, math.ceil(math.log(states.getNumPartitions(), 16))))


@dataclass
class Whitening:
    """Of vectors of one length: the largest components, falling."""

    n: int
    sums: list[int]
    components: np.ndarray  # one a column
    eigenvalues: np.ndarray
    explained: list[float | None]
    identity_error: float | None = None

    @classmethod
    def of(cls, m: Moments, k: int) -> Whitening:
        values, vectors = np.linalg.eigh(m.scatter / m.n)
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        trace = float(np.trace(m.scatter)) / m.n
        return cls(m.n, m.sums, vectors, np.where(values > FLAT * trace, values, 0.0), [float(v) / trace if trace > 0 else None for v in values])

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of x; components without variance are NaN."""
        centred = x - np.array([s / self.n for s in self.sums])
        scale = np.sqrt(np.where(self.eigenvalues > 0, self.eigenvalues, np.nan))
        return (centred @ self.components) / scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum of (n * x - sums)^2 of each row, exactly; None beyond a long."""
        far = np.abs(x.astype(float) * self.n - np.array(self.sums, float)).max(axis=1, initial=0.0) + 1
        if max(map(abs, self.sums), default=0) < 2**62 and float(np.abs(x).max(initial=0)) * self.n < 2**62 and (x.shape[1] * far * far < 2**62).all():
            apart = x * self.n - np.array(self.sums, np.int64)
            return (apart * apart).sum(axis=1).tolist()
        exact = (sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums)) for row in x)
        return [v if v < 2**63 else None for v in exact]


def fit(fitted: DataFrame, k: int = COMPONENTS) -> dict[int, Whitening]:
    """The whitening of each length of vectors in fitted (a column x of distinct vectors, read twice: stored)."""
    points = fitted.select(F.size("x").alias("dim"), F.col("x").alias("v"))
    models = {d: Whitening.of(m, k) for d, m in moments(points).items()}

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, _, x in blocks(batch.column("v")):
                scaled = models[d].project(x)[:, models[d].eigenvalues > 0]
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(x), pa.int32()), pa.array(list(scaled), pa.list_(pa.float64()))], ["dim", "v"])

    for d, m in moments(points.mapInArrow(whiten, "dim int, v array<double>")).items():
        models[d].identity_error = float(np.abs(m.scatter / m.n - np.eye(len(m.mean))).max())
    return models


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def apply(rows: DataFrame, models: dict[int, Whitening]) -> DataFrame:
    """A row for each vector of rows (vec_id, x) and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in blocks(batch.column("x")):
                m = models[d]
                k = len(m.eigenvalues)
                ids = batch.column("vec_id").take(pa.array(np.repeat(at, k)))
                deviation = pa.array(m.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k)))
                repeated = lambda values, kind: pa.array(list(values) * len(at), kind)
                columns = [ids, repeated(range(1, k + 1), pa.int32()), repeated([m.n] * k, pa.int64()), deviation, pa.array(m.project(x).ravel(), from_pandas=True), repeated(m.explained, pa.float64()), repeated([m.identity_error] * k, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, RESULT)


def whiten(rows: DataFrame, vector: str = "embedding", id_column: str = "vec_id", k: int = COMPONENTS) -> DataFrame:
    """The k largest whitened components of every vector, with what they explain and how far the whole is from white."""
    points = fixed_point(rows, vector, id_column)
    return apply(points, fit(durable(points.select("x").distinct(), "fit"), k))
