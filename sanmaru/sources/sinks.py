"""Sinks: cubes as JSON or Parquet, ranked rows as CSV, checksums and keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cube_documents(cube: DataFrame, layer: str, metrics: list[str]) -> DataFrame:
    """One row for each cell: ``layer_id, code, months, series`` with every series as long as ``months``.

    Months that a cell lacks are null in its series.
    """
    months = F.broadcast(cube.select("month_no").distinct())
    grid = cube.select("code").distinct().crossJoin(months).join(cube, ["code", "month_no"], "left")
    cells = grid.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("month_no", *metrics))).alias("rows"))  # a cell has one row a month
    series = F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*[F.col(f"rows.{m}").cast("array<double>") for m in metrics]))
    return cells.select(F.lit(layer).alias("layer_id"), "code", F.col("rows.month_no").alias("months"), series.alias("series"))


def write_cube_json(cube: DataFrame, layer: str, metrics: list[str], path: str) -> None:
    cube_documents(cube, layer, metrics).write.mode("overwrite").json(path)


def write_ranked_csv(rows: DataFrame, path: str) -> None:
    """RFC 4180 quoting and CRLF line ends."""
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("lineSep", "\r\n").csv(path)


def checksum(rows: DataFrame) -> DataFrame:
    """SHA-256 over a table whatever the order of its rows: over the sums of eight parts of all row digests."""
    digests = rows.select(F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)])), 256).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    sums = digests.select(*[(F.conv(F.substring("h", i * 8 + 1, 8), 16, 10).cast("decimal(20,0)") * F.col("n")).alias(f"s{i}") for i in range(8)])
    return sums.agg(*[F.coalesce(F.sum(f"s{i}"), F.lit(0)).cast("string").alias(f"s{i}") for i in range(8)]).select(F.sha2(F.concat_ws("|", *[f"s{i}" for i in range(8)]), 256).alias("checksum"))


def upsert(base: DataFrame, update: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with the rows of ``update`` in place of those with the same keys; write the result to a new path."""
    return base.join(update.select(*keys).distinct(), keys, "left_anti").unionByName(update)


def csv_cell(value: Column) -> Column:
    """A cell as RFC 4180 has it: in quotes only where it holds a quote, a comma or a line end; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(rows: DataFrame, headers: list[str], order: str, meta: list[tuple[str, str]] = ()) -> DataFrame:
    """``line_no, value``: lines of ``meta``, an empty line after them if there are any, the header and the rows by ``order``.

    ``order`` is an integer from 1 (a rank) and the other columns are cells. The first line starts with a byte order mark.
    """
    spark = rows.sparkSession
    quote = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in '",\n\r') else v
    head = [f"{k},{quote(v)}" for k, v in meta] + ([""] if meta else []) + [",".join(map(quote, headers))]
    first = spark.createDataFrame([(i - len(head) + 1, ("\ufeff" if i == 0 else "") + v) for i, v in enumerate(head)], "line_no long, value string")
    cells = [csv_cell(F.col(c)) for c in rows.columns if c != order]
    return first.union(rows.select(F.col(order).cast("long"), F.concat_ws(",", *cells)))


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines in order, ends CRLF. Files are ranges of lines in the order of their names."""
    lines.orderBy("line_no").select("value").write.option("lineSep", "\r\n").text(path)


def write_features(features: DataFrame, path: str) -> None:
    """``properties, polygons`` as GeoJSON features, one to a line."""
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), F.col("polygons").alias("coordinates"))
    features.select(F.to_json(F.struct(F.lit("Feature").alias("type"), "properties", geometry.alias("geometry"))).alias("value")).write.text(path)


def boundary_metadata(codes: DataFrame, files: DataFrame, version: str) -> DataFrame:
    """``version, crs, sha256, feature_count, codes`` of a boundary; ``files`` are read as binary files.

    A code that isn't ten digits or comes twice is an error. Regions are administrative units, so their codes fit a row.
    """
    counted = codes.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    fine = F.when(F.col("code").rlike(r"^\d{10}$") & (F.col("n") == 1), F.col("code")).otherwise(F.raise_error(F.concat(F.lit("bad or repeated code "), F.coalesce("code", F.lit("null")))).cast("string"))
    listed = counted.select(fine.alias("code")).agg(F.array_sort(F.collect_list("code")).alias("codes"))
    digests = files.select("path", F.sha2("content", 256).alias("h")).agg(F.array_sort(F.collect_list(F.struct("path", "h"))).alias("f"))
    whole = F.when(F.size("f") == 1, F.col("f")[0]["h"]).otherwise(F.sha2(F.array_join("f.h", ""), 256))
    return listed.crossJoin(digests).select(F.lit(version).alias("version"), F.lit("EPSG:4326").alias("crs"), whole.alias("sha256"), F.size("codes").alias("feature_count"), "codes")


def upsert_batches(base: DataFrame, updates: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Upsert numbered updates (``seq`` from 0) in batches of ``size``; in a batch and between batches the later row wins."""
    rest = [c for c in updates.columns if c not in (*keys, "seq")]
    batch = F.floor(F.col("seq") / size)
    last = updates.groupBy(*keys, batch.alias("batch")).agg(F.max_by(F.struct(*rest), "seq").alias("r"))
    final = last.groupBy(*keys).agg(F.max_by("r", "batch").alias("r")).select(*keys, "r.*")
    return upsert(base, final, keys)
