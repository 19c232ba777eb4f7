"""Readers of the raw feeds. All fields are read as text; required columns are checked by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sanmaru.functions.codes import field_number, hour_label, normal_month, pad_code


def allow_java_charsets(spark: SparkSession) -> None:
    """Let this session read and write CP949 (``x-windows-949``)."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def read_psv(spark: SparkSession, path: str, required: list[str], encoding: str = "UTF-8") -> DataFrame:
    """Pipe-separated text with a header. Fails if a required column is missing; keeps only those columns.

    CP949 is ``x-windows-949``; Spark reads it only where ``spark.sql.legacy.javaCharsets`` is set.
    """
    df = spark.read.option("sep", "|").option("header", True).option("encoding", encoding).csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*required)


def band_columns(columns: list[str]) -> list[str]:
    """Columns of sex and age bands, such as M00 or F75."""
    import re

    return [c for c in columns if re.fullmatch(r"[MF]\d\d", c)]


def read_headerless(spark: SparkSession, path: str, names: list[str], sep: str = ",") -> DataFrame:
    """Text without a header and with fixed places; a byte order mark before the first field goes.

    Lines are split whole, so an empty field stays empty and only a missing one is null.
    """
    fields = F.split("value", f"[{sep}]", -1)
    df = spark.read.text(path).select(*[F.get(fields, F.lit(i)).alias(n) for i, n in enumerate(names)])
    return df.withColumn(names[0], F.regexp_replace(names[0], "^﻿", ""))


POINT = T.ArrayType(T.DoubleType())
RINGS = T.ArrayType(T.ArrayType(POINT))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features as ``properties`` and ``polygons``; a polygon becomes a multi-polygon of one."""
    schema = T.StructType(
        [
            T.StructField("features", T.ArrayType(T.StructType([T.StructField("properties", T.MapType(T.StringType(), T.StringType())), T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]))])))
        ]
    )
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.properties", "f.geometry.type", "f.geometry.coordinates")
    one = F.array(F.from_json("coordinates", RINGS))
    return f.select("properties", F.when(F.col("type") == "Polygon", one).otherwise(F.from_json("coordinates", T.ArrayType(RINGS))).alias("polygons"))


def result_code(column: str) -> Column:
    """The result code of a JSON response, under its header, its head or itself; null if it has none."""
    v = F.try_parse_json(column)
    return F.coalesce(*[F.try_variant_get(v, f"{r}{h}.resultCode", "string") for r in ("$.response", "$.Response", "$") for h in (".header", ".head", "")])


def parse_envelope(df: DataFrame, column: str, item: str) -> DataFrame:
    """Items of a JSON response envelope: ``response`` or ``Response``, ``body`` optional, ``item`` a list or one object.

    Rows whose result code is not 0, 00 or INFO-000 raise. ``item`` is the schema of an item.
    """
    v = F.try_parse_json(column)
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    roots, code = ("$.response", "$.Response", "$"), result_code(column)
    ok = F.coalesce(code.isin("0", "00", "INFO-000"), F.lit(True))
    bodies = [f"{r}{b}.items.item" for r in roots for b in (".body", "")]
    many = F.coalesce(*[get(p, f"array<{item}>") for p in bodies])
    one = F.coalesce(*[get(p, item) for p in bodies])
    rows = F.when(ok, F.coalesce(many, F.when(one.isNotNull(), F.array(one)))).otherwise(F.raise_error(F.concat(F.lit("result code "), code)))
    return df.select(F.explode(rows).alias("item")).select("item.*")


def read_xml_items(spark: SparkSession, path: str, schema: T.StructType, row_tag: str = "item") -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def band_total(columns: list[str], start: str, skip: int = 1) -> Column:
    """Sum of the fields from M00 on, or from ``skip`` places after ``start``; what is no finite number adds nothing."""
    first = columns.index("M00") if "M00" in columns else columns.index(start) + skip
    total = F.lit(0.0)
    for c in columns[first:]:
        v = field_number(F.col(c))
        total = total + F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v).otherwise(0.0)
    return total


def _headed(spark: SparkSession, path: str, required: list[str], month: str) -> tuple[DataFrame, list[str]]:
    """All columns of a pipe-separated feed, and those of the file itself; ``month`` may be a folder of the path."""
    df = spark.read.option("sep", "|").option("header", True).csv(path)
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    missing = [c for c in [*required, month] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df, [c for c in df.columns if c != month]


def read_living(spark: SparkSession, path: str, month: str = "ym") -> DataFrame:
    """``code, month, total, elderly``: sums over the bands, and over those from 65 on."""
    df, columns = _headed(spark, path, ["ADMDONG_CD"], month)
    old = [field_number(F.col(c)) for c in band_columns(columns) if int(c[1:]) >= 65]
    elderly = sum((F.coalesce(v, F.lit(0.0)) for v in old), F.lit(0.0))
    return df.select(pad_code(F.col("ADMDONG_CD")).alias("code"), normal_month(F.col(month).cast("string")).alias("month"), band_total(columns, "ADMDONG_CD").alias("total"), elderly.alias("elderly"))


def read_day_night(spark: SparkSession, path: str, month: str = "ym") -> DataFrame:
    """``code, month, hour, total``; hours of one digit are padded."""
    df, columns = _headed(spark, path, ["TIMEZN_CD", "ADMDONG_CD"], month)
    hour = hour_label(F.col("TIMEZN_CD")).try_cast("int")
    return df.select(pad_code(F.col("ADMDONG_CD")).alias("code"), normal_month(F.col(month).cast("string")).alias("month"), hour.alias("hour"), band_total(columns, "ADMDONG_CD").alias("total"))


def read_mobility(spark: SparkSession, path: str, month: str = "ym") -> DataFrame:
    """``code, month, date, total`` of an inflow file (its cell is ADM_CD) or an outflow file (RSDN_ADM_CD)."""
    df, columns = _headed(spark, path, ["BASE_DATE"], month)
    cell = next((c for c in ("ADM_CD", "RSDN_ADM_CD") if c in columns), None)
    if not cell:
        raise ValueError("missing columns: ADM_CD or RSDN_ADM_CD")
    rows = df.filter(F.coalesce(cell, F.lit("")) != "")
    return rows.select(pad_code(F.col(cell)).alias("code"), normal_month(F.col(month).cast("string")).alias("month"), F.col("BASE_DATE").alias("date"), band_total(columns, cell, 2).alias("total"))


def read_centroids(spark: SparkSession, path: str) -> DataFrame:
    """``gid, x, y, lon, lat`` of the grid; rows whose x or longitude is no finite number go."""
    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])
    number = lambda c: F.col(c).try_cast("double")
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    rows = df.select(F.col(df.columns[0]).alias("gid"), number("center_x_5179").alias("x"), number("center_y_5179").alias("y"), number("longitude").alias("lon"), number("latitude").alias("lat"))
    return rows.filter(finite("x") & finite("lon"))


def read_cube_json(spark: SparkSession, path: str, metrics: list[str]) -> DataFrame:
    """Cube documents as rows ``code, month_no`` and the metrics; months where a cell knows none of them go."""
    docs = spark.read.schema("layer_id string, code string, months array<int>, series map<string, array<double>>").json(path)
    zipped = F.arrays_zip(F.col("months").alias("month_no"), *[F.element_at("series", m).alias(m) for m in metrics])
    rows = docs.select("code", F.explode(zipped).alias("p")).select("code", "p.*")
    return rows.filter(F.coalesce(*metrics).isNotNull())


def rows_of(df: DataFrame, column: str, item: str) -> DataFrame:
    """Rows of a JSON array, of ``{"items": [...]}`` or of a response envelope; anything else is an error."""
    v = F.try_parse_json(column)
    listed = F.coalesce(*[F.try_variant_get(v, p, f"array<{item}>") for p in ("$", "$.items")])
    plain = df.withColumn("listed_", listed)
    bare = plain.filter("listed_ is not null").select(F.explode("listed_").alias("item")).select("item.*")
    other = plain.filter("listed_ is null")
    known = F.coalesce(*[F.try_variant_get(v, p, "variant") for p in ("$.response", "$.Response")]).isNotNull()
    checked = F.when(known, F.col(column)).otherwise(F.raise_error(F.lit("no rows, items or response")).cast("string"))
    return bare.union(parse_envelope(other.select(checked.alias(column)), column, item))


def latest_version(names: Column) -> Column:
    """The date of ``ver<YYYYMMDD>``, null if the name has another form or no such day; take its maximum."""
    digits = F.regexp_extract(names, r"^ver(\d{8})$", 1)
    return F.when(F.try_to_timestamp(digits, F.lit("yyyyMMdd")).isNotNull(), digits)


def newest_published(snapshots: DataFrame, mode: str) -> DataFrame:
    """The published snapshot of ``mode`` that was created last, or no row."""
    return snapshots.filter(F.col("is_published") & (F.col("mode") == mode)).orderBy(F.desc("created_at")).limit(1)
