"""Session builder with the settings every job of this library expects."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "sanmaru", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; ``master`` and ``partitions`` only where the cluster sets none."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def local_cpus() -> int:
    return int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share. Only a local session may go without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or f"file:///tmp/sanmaru-shared/{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the folder that driver and executors share and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = shared_path(spark, "written")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_upto(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (counted now), else as it is, so that the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
