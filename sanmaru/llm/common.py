"""What the operators share: tables, the shared scratch folder and size-checked broadcasts."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may go without one: it gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file:///tmp/sanmaru-shared/{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: later steps survive lost executors without recomputing it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/sanmaru-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_upto(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (counted now), else as it is, so that the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def broadcast_bytes(df: DataFrame, *large: str, limit: int = 64 << 20) -> DataFrame | None:
    """``df`` with a broadcast hint if its rows, with the strings and arrays in ``large``, take at most ``limit`` bytes, else None."""
    sizes = [F.coalesce(F.length(c) if dict(df.dtypes)[c] in ("string", "binary") else 8 * F.size(c), F.lit(0)) for c in large]
    total = df.agg(F.sum(sum(sizes, F.lit(100))).alias("bytes")).first().bytes or 0
    return F.broadcast(df) if total <= limit else None


def running_starts(sizes: DataFrame, keys: list[str], bucket: str, value: str, span: int = 4096) -> DataFrame:
    """``keys, bucket, before``: what ``value`` adds up to in the lower buckets of the same keys.

    Runs of ``span`` buckets are summed first, so that no task ranks all buckets of a key with very many rows.
    """
    before = lambda by, order: W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    runs = sizes.withColumn("run_", F.floor(F.col(bucket) / span))
    firsts = runs.groupBy(*keys, "run_").agg(F.sum(value).alias("all_"))
    firsts = firsts.select(*keys, "run_", F.coalesce(F.sum("all_").over(before(keys, "run_")), F.lit(0)).alias("first_"))
    inside = runs.withColumn("before", F.coalesce(F.sum(value).over(before([*keys, "run_"], bucket)), F.lit(0)))
    return inside.join(firsts, [*keys, "run_"]).select(*keys, bucket, (F.col("before") + F.col("first_")).alias("before"))


def give_back() -> None:
    """Memory that this Python process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; at the end of a task the Python worker, which Spark keeps, gives freed memory back."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied
