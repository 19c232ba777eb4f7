"""Incremental ingestion: month files that arrive in a folder are folded into running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sanmaru.functions.codes import clean_code, field_number
from sanmaru.operators.ingest import valid_codes


def card_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Rows of the headerless card feed: ``code, month, txns, amount`` from places 0, 1, 9 and 10."""
    f = F.split("value", "[,]", -1)
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    month = F.concat_ws("-", F.substring(f[1], 1, 4), F.substring(f[1], 5, 2))
    return valid_codes(lines.select(clean_code(f[0]).alias("code"), month.alias("month"), field_number(F.get(f, F.lit(9))).alias("txns"), field_number(F.get(f, F.lit(10))).alias("amount")))


def run_card_totals(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Fold all files that have come since the last run into part sums under ``out``, then stop.

    Each batch appends its own sums in a folder of its number, so that a repeated batch replaces what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("code", "month").agg(F.sum("txns").alias("txns"), F.sum("amount").alias("amount"))
        sums.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return card_stream(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def card_totals(spark: SparkSession, out: str) -> DataFrame:
    """``code, month, txns, amount`` over all batches."""
    return spark.read.parquet(out).groupBy("code", "month").agg(F.sum("txns").alias("txns"), F.sum("amount").alias("amount"))
