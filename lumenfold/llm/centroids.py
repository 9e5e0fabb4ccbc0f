"""Centroid clustering by annulus search, in whole numbers.

Vectors are cut to whole numbers (floor of SCALE times each component), so sums, means and distances are exact and don't depend on the
order of rows. In each round the centroids, K rows, go to every task, sorted by norm. The distance of a vector to the centroid
nearest in norm bounds that to its own from above, and a centroid whose norm differs from the vector's by more than that bound is farther away: the
centroids in the annulus are found by two binary searches, and compared exactly, those on its boundary with the others; of
equal distances the smaller number is taken. The bound needs nothing of the round before, so no table of assignments is written a round.
On vectors of one norm, around centroids of one norm, the annulus holds nearly all centroids.

A task adds up its vectors by centroid, so a cluster that a third of all vectors belong to is K rows a task; K x DIMENSIONS sums
come to the driver in a round.

Cases: a vector that is null, of another number of components, or with a component that is null or not finite is left out; rows that
repeat are vectors of their own; null ids come last among the first centroids, equal ids by their components; with fewer
vectors than centroids each vector is one; extra columns are ignored; without vectors there is no row. A component beyond
LIMIT is refused in words, as squared distances of such vectors don't fit 64 bits. vec_id must be a whole number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.scratch import whole_numbers, written

K, ROUNDS, DIMENSIONS, SCALE, SEED = 40, 5, 64, 256, "2:"
#: Largest whole number of a component: 64 squared differences of twice that fit a long.
LIMIT = 1 << 27
#: Vectors that are compared at once.
SLICE = 4_096


def kept(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id and x (whole numbers) of the vectors that can be used."""
    usable = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where((F.size("v") == dimensions) & F.forall("v", usable))
    refused = F.raise_error(F.lit(f"a component beyond {LIMIT // SCALE} in size: squared distances don't fit 64 bits")).cast("int")
    return rows.select("vec_id", F.transform("v", lambda v: F.when(F.abs(v * SCALE) < LIMIT, F.floor(v * float(SCALE)).cast("int")).otherwise(refused)).alias("x"))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid, the smaller number of those equally near."""
    size = np.sqrt((centroids**2).sum(1).astype(np.float64))
    order = np.argsort(size, kind="stable")
    norms, sorted_ = size[order], centroids[order]
    own = np.sqrt((x**2).sum(1).astype(np.float64))
    at = np.clip(np.searchsorted(norms, own), 1, max(1, len(norms) - 1))
    guess = np.minimum(np.where(own - norms[at - 1] <= norms[np.minimum(at, len(norms) - 1)] - own, at - 1, at), len(norms) - 1)
    bound = np.sqrt(((x - sorted_[guess]) ** 2).sum(1).astype(np.float64))
    slack = 1e-9 * (1 + own + bound)  # rounding: what is on the boundary stays in
    low, high = np.searchsorted(norms, own - bound - slack), np.searchsorted(norms, own + bound + slack, "right")
    best, number = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(order))
    for k in range(len(order)):
        inside = np.flatnonzero((low <= k) & (k < high))
        apart = ((x[inside] - sorted_[k]) ** 2).sum(1)
        closer = (apart < best[inside]) | ((apart == best[inside]) & (order[k] < number[inside]))
        best[inside[closer]], number[inside[closer]] = apart[closer], order[k]
    return number, best


def _slices(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
        yield batch, batch.column("x").flatten().to_numpy().astype(np.int64).reshape(-1, dimensions)


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for _, x in _slices(batches, centroids.shape[1]):
            number, _ = nearest(x, centroids)
            np.add.at(total, number, x)
            count += np.bincount(number, minlength=len(centroids))
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(count[own]), pa.array(list(total[own]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _slices(batches, centroids.shape[1]):
            number, apart = nearest(x, centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(apart)], ["vec_id", "cluster", "distance"])

    return run


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the means of their vectors; those without vectors stay."""
    sums = rows.mapInArrow(_sums(centroids), "cluster int, n long, total array<long>")
    parts = sums.select("cluster", "n", F.posexplode("total").alias("at", "s")).groupBy("cluster", "at")
    after = centroids.copy()
    for r in parts.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # K x DIMENSIONS rows
        after[r.cluster, r.at] = int(r.s) // r.n
    return after


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that can be used."""
    whole_numbers(vectors, column="vec_id")
    rows = written(kept(vectors, dimensions))
    first = F.sha2(F.concat(F.lit(SEED), F.col("vec_id").cast("string")), 256)
    start = rows.orderBy(first.asc_nulls_last(), "x").limit(k).collect()
    centroids = np.array([r.x for r in start], np.int64).reshape(-1, dimensions)
    if len(start):
        for _ in range(rounds):
            centroids = moved(rows, centroids)
    schema = "vec_id long, cluster int, distance long"
    found = written(rows.mapInArrow(_assigned(centroids), schema)) if len(start) else rows.sparkSession.createDataFrame([], schema)
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    inertia = {r.cluster: int(r.s) for r in sums}
    named = [(c, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    named = found.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
