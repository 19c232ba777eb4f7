"""Delivery folders: which hold a file, and which of those a manifest hasn't seen yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER = "folder string"


def month_folders(spark: SparkSession, root: str, file: str) -> DataFrame:
    """``folder, files, bytes`` of each folder of ``root`` that holds ``file`` (a file or a folder of part files).

    Files are listed by Spark with their lengths; their content isn't read. Marker files don't count.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    at = F.regexp_extract("path", rf"([^/]+)/{file}(/part-[^/]*)?$", 1)
    return found.select(at.alias("folder"), "length").filter("folder <> ''").groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def open_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The folders that a manifest lists; a manifest that isn't there is begun empty."""
    spark.createDataFrame([], FOLDER).write.mode("append").parquet(path)
    return spark.read.schema(FOLDER).parquet(path).distinct()


def new_folders(spark: SparkSession, root: str, file: str, manifest: str) -> DataFrame:
    """Folders with ``file`` that the manifest doesn't list. List them with ``mark_seen`` once their rows are stored."""
    return month_folders(spark, root, file).join(open_manifest(spark, manifest), "folder", "left_anti")


def mark_seen(folders: DataFrame, manifest: str) -> None:
    """Add ``folders`` to the manifest; a rerun after a failure in between takes them again."""
    folders.select("folder").write.mode("append").parquet(manifest)
