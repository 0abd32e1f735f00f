"""Centroid clustering of integer vectors, screened by norms of blocks.

A component x becomes floor(scale * x). A vector is cut into blocks of ``BLOCK`` components; of each, the sum s and the
norm r of what is left without its mean are computed once and stored beside the vector. For two vectors Cauchy-Schwarz
gives, block by block,

    squared distance >= (s - s')^2 / BLOCK + (r - r')^2

so the few numbers of the blocks bound the distance from below, without the components. A vector's exact integer
distance to the centroid of the smallest bound is computed first; another centroid gets an exact distance only where its
bound is not above the best so far. Bounds are lowered by more than floating point can err, so no nearest centroid and
no tie is lost.

Vectors stay where they are: each round broadcasts the centroids (``k`` times ``dims`` integers, the parameters of the
call) and adds up, in a task first, at most one row of sums for a centroid. A centroid that holds most vectors is no
larger a row than another. Centroids are exact: sums are integers, and a mean is rounded down.

Defined results: a vector that is null, has another number of components, or a null or non-finite component, is left
out; a null id is kept and is drawn as a first centroid only where other vectors lack; repeated rows are vectors of
their own; of vectors of one id (or of ids with one hash) the one with smaller components comes first; with fewer
vectors than ``k`` there are as many centroids as vectors; a centroid without vectors stays; an empty table gives an
empty result. Other columns are not read. A scaled component beyond 2^27 raises an error: its distances would not fit
into a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, small_batches

BLOCK = 8
#: Scaled components up to this size have distances that fit into a long, for up to 128 components.
LARGEST = 1 << 27
#: Relative error that bounds are lowered by; that of the sums and roots in them is far below.
SLACK = 1e-9


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has ``dims`` components, none null or non-finite."""
    x = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, x), F.lit(False))


def quantised(values: np.ndarray, scale: float) -> np.ndarray:
    q = np.floor(scale * values)
    if len(q) and np.abs(q).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} when scaled by {scale}")
    return q.astype(np.int64)


def blocks(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and residual norm of each block of the rows of ``q``; the last block is filled up with zeros."""
    n, dims = q.shape
    q = np.pad(q, ((0, 0), (0, -dims % BLOCK))).reshape(n, -(-dims // BLOCK), BLOCK).astype(np.float64)
    s = q.sum(2)
    return s, np.sqrt(((q - s[:, :, None] / BLOCK) ** 2).sum(2))


@dataclass
class Screen:
    """Centroids with the numbers of their blocks."""

    centroids: np.ndarray

    def __post_init__(self) -> None:
        self.s, self.r = blocks(self.centroids)
        self.size = (self.centroids.astype(np.float64) ** 2).sum(1)

    def bounds(self, q: np.ndarray, s: np.ndarray, r: np.ndarray) -> np.ndarray:
        """For each vector and centroid, a number that the squared distance is not below."""
        size = (q.astype(np.float64) ** 2).sum(1)
        out = np.empty((len(q), len(self.centroids)))
        for j in range(len(self.centroids)):
            out[:, j] = ((s - self.s[j]) ** 2).sum(1) / BLOCK + ((r - self.r[j]) ** 2).sum(1) - SLACK * (size + self.size[j] + 1)
        return out

    def nearest(self, q: np.ndarray, s: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of each vector's nearest centroid (ties: the smaller number), and how many exact
        distances that took."""
        bounds = self.bounds(q, s, r)
        first = bounds.argmin(1)
        best, where = ((q - self.centroids[first]) ** 2).sum(1), first.copy()
        exact = len(q)
        for j in range(len(self.centroids)):
            ask = np.flatnonzero((bounds[:, j] <= best) & (first != j))
            exact += len(ask)
            d = ((q[ask] - self.centroids[j]) ** 2).sum(1)
            closer = (d < best[ask]) | ((d == best[ask]) & (j < where[ask]))
            best[ask[closer]], where[ask[closer]] = d[closer], j
        return where, best, exact


def packed(vectors: DataFrame, key: str, vector: str, dims: int, scale: float) -> DataFrame:
    """``key``, and as binaries q (the components, int32), s and r (of the blocks, float64) of the usable vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = quantised(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), scale)
            cols = [[x.tobytes() for x in rows] for rows in (q.astype(np.int32), *blocks(q))]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.binary()) for c in cols]], names=[key, "q", "s", "r"])

    v = F.col(f"`{vector}`")
    held = vectors.select(F.col(f"`{key}`").alias(key), v.cast("array<double>").alias("_v")).where(usable(F.col("_v"), dims))
    return held.mapInArrow(run, held.select(key).schema.add("q", "binary").add("s", "binary").add("r", "binary"))


def unpacked(b: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n_blocks = -(-dims // BLOCK)
    column = lambda i, kind, width: np.frombuffer(b"".join(b.column(i).to_pylist()), kind).reshape(-1, width)
    return column(1, np.int32, dims).astype(np.int64), column(2, np.float64, n_blocks), column(3, np.float64, n_blocks)


def components_of(q: bytes) -> list[int]:
    return np.frombuffer(q, np.int32).tolist()


def first_centroids(held: DataFrame, key: str, k: int, salt: str) -> list[list[int]]:
    """The ``k`` vectors of the smallest hashes of salt:key. Spark keeps no more than ``k`` rows of a task."""
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string")), 256)
    drawn = held.select(name.alias("h"), "q").orderBy(F.asc_nulls_last("h"), "q").limit(k).collect()
    return [q for _, q in sorted(((r["h"] is None, r["h"] or ""), components_of(r["q"])) for r in drawn)]


def moved(held: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """Centroids at the means (rounded down) of the vectors nearest to them."""
    screen = held.sparkSession.sparkContext.broadcast(Screen(np.array(centroids, np.int64).reshape(-1, dims)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(screen.value.centroids)
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in batches:
            q, s, r = unpacked(b, dims)
            where, _, _ = screen.value.nearest(q, s, r)
            np.add.at(sums, where, q)
            counts += np.bincount(where, minlength=k)
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts[own]), pa.array(sums[own].tolist(), pa.list_(pa.int64()))], names=["c", "n", "sums"])

    parts = held.mapInArrow(run, "c long, n long, sums array<long>")
    each = parts.select("c", "n", F.posexplode("sums").alias("i", "x")).groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out = [list(c) for c in centroids]
    for row in each.collect():  # k times dims rows
        out[row["c"]][row["i"]] = int(row["x"]) // row["n"]
    return out


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, salt: str = "1") -> DataFrame:
    """``key``, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every usable vector."""
    spark = vectors.sparkSession
    small_batches(spark, 10_000)
    held = cut(packed(vectors, key, vector, dims, scale))
    centroids = first_centroids(held, key, k, salt)
    for _ in range(rounds if centroids else 0):
        centroids = moved(held, centroids, dims)
    screen = spark.sparkContext.broadcast(Screen(np.array(centroids, np.int64).reshape(-1, dims)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where, best, _ = screen.value.nearest(*unpacked(b, dims))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(where.astype(np.int32)), pa.array(best)], names=[key, "cluster", "distance"])

    near = cut(held.mapInArrow(run, held.select(key).schema.add("cluster", "integer").add("distance", "long")))
    sums = near.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    digests = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    names = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    each = F.broadcast(sums.join(F.broadcast(names), "cluster"))  # one row a centroid
    total = F.broadcast(sums.agg(F.sum("cluster_inertia").alias("inertia")))
    return near.join(each, "cluster").crossJoin(total).select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
