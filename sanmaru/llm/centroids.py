"""Centroid clustering: norms of segments screen centroids before exact integer distances.

The distance between two vectors is at least the difference of their norms, segment by segment (Cauchy-Schwarz), so the
squared differences of segment norms add up to a lower bound. Vectors are stored once with the norms of their segments;
each round computes the centroids' norms, the exact distance to the centroid of the least bound, and then to those
centroids only whose bound doesn't exceed it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sanmaru.llm.common import cut, tidy
from sanmaru.llm.vectors import integers, matrix

DIM, CLUSTERS, ROUNDS, SEGMENTS = 64, 16, 3, 8
#: Vectors assigned at once.
CHUNK = 2048


def segment_norms(x: np.ndarray) -> np.ndarray:
    """Norms of ``SEGMENTS`` equal segments of each row."""
    return np.sqrt((x.astype(np.float64) ** 2).reshape(len(x), SEGMENTS, -1).sum(axis=2))


def screened(norms: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Lower bounds of squared distances, rows by centroids; a little lower still, for rounding."""
    own = segment_norms(centroids)
    square = (norms**2).sum(axis=1)[:, None] + (own**2).sum(axis=1)[None, :]
    return square - 2 * (norms @ own.T) - 1e-9 * square - 1e-6


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row (ties: the smaller number), its squared distance, and how many exact distances that took."""
    bounds = screened(norms, centroids)
    first = bounds.argmin(axis=1)
    best, cluster = ((x - centroids[first]) ** 2).sum(axis=1), first.copy()
    exact = len(x)
    for c, centroid in enumerate(centroids):
        left = np.flatnonzero((bounds[:, c] <= best) & (first != c))
        if len(left):
            exact += len(left)
            distance = ((x[left] - centroid) ** 2).sum(axis=1)
            better = (distance < best[left]) | ((distance == best[left]) & (c < cluster[left]))
            best[left[better]], cluster[left[better]] = distance[better], c
    return cluster, best, exact


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Identifiers, vectors and segment norms."""
    for batch in batches:
        for lo in range(0, batch.num_rows, CHUNK):
            part = batch.slice(lo, CHUNK)
            yield part.column(0), matrix(part.column(1), DIM), np.asarray(part.column(2).flatten()).reshape(-1, SEGMENTS)


def _with_norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, CHUNK):
            part = batch.slice(lo, CHUNK)
            norms = segment_norms(matrix(part.column(1), DIM))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(norms) + 1, dtype=np.int32) * SEGMENTS), pa.array(norms.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["vec_id", "x", "norms"])


def _moved(ready: DataFrame, held) -> DataFrame:
    """``cluster, n, s0, s1, ...``: vectors of each cluster and the sums of their components."""
    names = [f"s{i}" for i in range(DIM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = held.value
        n, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), DIM), np.int64)
        for _, x, norms in _chunks(batches):
            cluster = nearest(x, norms, centroids)[0]
            n += np.bincount(cluster, minlength=len(n))
            np.add.at(sums, cluster, x)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), *(pa.array(sums[used, i]) for i in range(DIM))], names=["cluster", "n", *names])

    schema = ", ".join(f"{c} long" for c in ("cluster", "n", *names))
    return ready.mapInArrow(tidy(run), schema).groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names))


def cluster_vectors(vectors: DataFrame, scale: float = 64.0, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each kept row: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Vectors with exactly 64 components, all finite, are kept; components become ``floor(scale * component)``. Centroids
    start as the 16 kept rows whose ``sha256("seed:vec_id")`` is smallest (equal identifiers: the smaller vector first;
    null identifiers last, as they have no hash), or as all rows if there are fewer. Three rounds assign and move; empty
    clusters stay. Repeated rows count as often as they occur; an empty table gives no rows; other columns are ignored.
    Vectors whose distances may not fit 64-bit integers are refused. The driver holds the centroids alone.
    """
    spark = vectors.sparkSession
    whole = integers(vectors, scale, id_col, vector_col).filter(F.size("x") == DIM)
    ready = cut(whole.mapInArrow(tidy(_with_norms), "vec_id long, x array<long>, norms array<double>"))
    most = ready.agg(F.max(F.array_max(F.transform("x", lambda e: F.abs(e.cast("double"))))).alias("most")).first().most
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if most is None:
        return spark.createDataFrame([], schema)
    if 4 * most**2 * DIM >= 2.0**62:
        raise ValueError("distances may not fit 64-bit integers")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    seeds = ready.select("x", order.alias("order_")).orderBy(F.asc_nulls_last("order_"), "x").limit(CLUSTERS).collect()  # at most CLUSTERS vectors
    centroids = np.array([r.x for r in seeds], np.int64)
    for _ in range(ROUNDS):
        moved = _moved(ready, spark.sparkContext.broadcast(centroids)).collect()  # at most CLUSTERS rows
        centroids = centroids.copy()
        for r in moved:
            centroids[r.cluster] = [r[2 + i] // r.n for i in range(DIM)]
    held = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, norms in _chunks(batches):
            cluster, distance, _ = nearest(x, norms, held.value)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    placed = cut(ready.mapInArrow(tidy(run), "vec_id long, cluster int, distance long"))
    inertia = {r.cluster: r.inertia for r in placed.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # at most CLUSTERS rows
    rows = [(c, n, sum(inertia.values()), ",".join(map(str, centroids[c].tolist()))) for c, n in inertia.items()]
    sums = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, words string").withColumn("centroid_sha256", F.sha2("words", 256)).drop("words")
    return placed.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row for each cluster
