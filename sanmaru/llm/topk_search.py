"""Exact top-k search by inner product: global score histograms are refined until they show each kth score."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sanmaru.llm.common import cut, shared_dir, tidy

#: Queries of a block, on average: their vectors, ranges and histograms (about 16 MB) are what a task holds besides its batch.
BLOCK_QUERIES = 4096
BINS = 512
#: Vectors scored at once.
CHUNK = 256


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of ``dim`` numbers; shorter ones end in zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    out, flat = np.zeros((len(sizes), dim)), np.asarray(lists.flatten(), dtype=np.float64)
    at = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[at] = flat
    return out


def _scored(batches: Iterator[pa.RecordBatch], ids: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Identifiers and scores (candidates by queries); a query's own row scores the least integer."""
    dim = vectors.shape[1]
    for batch in batches:
        for lo in range(0, batch.num_rows, CHUNK):
            part = batch.slice(lo, CHUNK)
            own = part.column(0).to_numpy(zero_copy_only=False)
            scores = _matrix(part.column(1), dim)
            scores = np.rint(scores @ vectors.T).astype(np.int64) if vectors.dtype == np.float64 else scores.astype(np.int64) @ vectors.T
            rows, cols = np.nonzero(own[:, None] == ids[None, :]) if np.isin(own, ids).any() else ((), ())
            scores[rows, cols] = np.iinfo(np.int64).min
            yield own, scores


def _histogram(vectors: DataFrame, held, k: int) -> DataFrame:
    """``(q, bin, n)`` of each task, from the highest bin down to that of the task's own kth score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, low, high, width = held.value
        counts, base = np.zeros((len(ids), BINS), np.int64), np.arange(len(ids)) * (BINS + 2)
        for _, scores in _scored(batches, ids, queries):
            bins = np.where(scores < high, (np.maximum(scores, low - 1) - low) // width + 1, BINS + 1)
            counts += np.bincount((bins + base).ravel(), minlength=len(ids) * (BINS + 2)).reshape(len(ids), -1)[:, 1:-1]
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        q, b = np.nonzero((counts > 0) & (above < k))
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(counts[q, b])], names=["q", "bin", "n"])

    return vectors.mapInArrow(tidy(run), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def _best(vectors: DataFrame, held, k: int) -> DataFrame:
    """Candidates above each query's kth score, and of those that equal it the ``k`` smallest identifiers of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, least = held.value
        kept = [np.zeros((0, 3), np.int64)]
        for own, scores in _scored(batches, ids, queries):
            v, q = np.nonzero((scores >= least) & (scores > np.iinfo(np.int64).min))
            kept.append(np.stack([q, own[v], scores[v, q]], axis=1))
            if sum(map(len, kept)) > 4 * k * len(ids) + 10_000:
                kept = [_smallest(np.concatenate(kept), k)]
        rows = _smallest(np.concatenate(kept), k)
        yield pa.RecordBatch.from_arrays([pa.array(ids[rows[:, 0]], pa.int64()), pa.array(rows[:, 1]), pa.array(rows[:, 2])], names=["query_id", "vec_id", "score"])

    return vectors.mapInArrow(tidy(run), "query_id long, vec_id long, score long")


def _smallest(rows: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` rows of each query by falling score, then identifier."""
    rows = rows[np.lexsort((rows[:, 1], -rows[:, 2], rows[:, 0]))]
    start = np.searchsorted(rows[:, 0], rows[:, 0])
    return rows[np.arange(len(rows)) - start < k]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest scores of each query, ties to the smaller identifier.

    Queries are the rows whose identifier is divisible by ``every``, candidates all rows but those with the query's
    identifier. Components become ``floor(scale * x)``. Scores are exact: by 64-bit floats while none can reach 2^53, else by
    64-bit integers; vectors whose scores may not fit those are refused. Vectors that are null or hold a null or
    non-finite component take no part, nor do null identifiers; shorter vectors, empty ones too, count as ending in zeros.
    Of repeated query rows that with the smallest vector asks, while repeated candidates are found as often as they occur.
    An empty table gives no rows. Blocks of queries run one after the other over all vectors; their results go to one folder.
    """
    spark = vectors.sparkSession
    x = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    ready = vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double")).cast("double")).alias("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, e: s + e * e))
    bound = ready.agg(F.max(norm).alias("norm"), F.max(F.size("x")).alias("dim"), F.count_if(F.col("vec_id") % every == 0).alias("queries")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not bound.queries:
        return spark.createDataFrame([], schema)
    if bound.norm**2 >= 2.0**62:
        raise ValueError("scores may not fit 64-bit integers")
    number = np.float64 if bound.norm**2 < 2.0**53 else np.int64
    blocks = -(-bound.queries // BLOCK_QUERIES)
    asked = ready.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    asked = cut(asked) if blocks > 1 else asked
    out = f"{shared_dir(spark).rstrip('/')}/top-k-{uuid.uuid4().hex}"
    part = spark.createDataFrame([], schema)
    for block in range(blocks):
        rows = asked.filter(F.col("block") == block).orderBy("vec_id").collect()  # about BLOCK_QUERIES vectors
        if not rows:
            continue
        ids, queries = np.array([r.vec_id for r in rows], np.int64), np.zeros((len(rows), bound.dim), number)
        for i, r in enumerate(rows):
            queries[i, : len(r.x)] = r.x
        most = np.ceil(np.linalg.norm(queries.astype(np.float64), axis=1) * bound.norm * (1 + 1e-9)).astype(np.int64) + 1
        low, high, width, need, done = -most, most + 1, -(-(2 * most + 1) // BINS), np.full(len(ids), k), np.zeros(len(ids), bool)
        while not done.all():
            held = spark.sparkContext.broadcast((ids, queries, low, high, width))
            above = F.sum("n").over(W.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, -1))
            hist = _histogram(ready, held, k).withColumn("above", F.coalesce(above, F.lit(0)))
            wanted = spark.createDataFrame(list(enumerate(need.tolist())), "q long, need long")
            hit = {r.q: r for r in hist.join(F.broadcast(wanted), "q").filter("above < need and above + n >= need").collect()}  # one row a query
            for q in np.flatnonzero(~done):
                if q not in hit:  # fewer than k candidates: all are wanted
                    low[q], done[q] = np.iinfo(np.int64).min + 2, True
                    continue
                low[q] += hit[q].bin * width[q]
                high[q] = min(high[q], low[q] + width[q])
                need[q] -= hit[q].above
                done[q] = width[q] == 1
                width[q] = -(-width[q] // BINS)
            held.unpersist()
        best = _best(ready, spark.sparkContext.broadcast((ids, queries, low)), k)
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        part = best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        if blocks > 1:
            part.write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out) if blocks > 1 else part
