"""The regional model over the driver's tables: cells, facilities, the monthly cube and region series.

No regional data is provided, so cells are nations (the 5-digit prefix of their code is the district, a region),
facilities are suppliers, and monthly metrics come from orders and line items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sanmaru.functions.codes import month_label

#: Months of region series: 2000-07 to 2001-07.
FIRST_MONTH, LAST_MONTH = 2000 * 12 + 6, 2001 * 12 + 6
FACILITY_TYPES = ("hospital", "clinic", "dental", "oriental", "care", "center", "public", "pharmacy")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _code(region_key: str, nation_key: str):
    return F.concat(F.lpad(F.col(region_key).cast("string"), 5, "0"), F.lpad(F.col(nation_key).cast("string"), 5, "0"))


def _place(key: str, lat_step: int, lng_step: int):
    k = F.col(key).cast("long")
    return (34.5 + (k * lat_step % 1400) / 1000.0), (127.5 + (k * lng_step % 1800) / 1000.0)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``code, name, sgg, ordinal, lat, lng, area_km2``: 25 rows at any scale."""
    lat, lng = _place("n_nationkey", 613, 1027)
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nation.select(
        _code("n_regionkey", "n_nationkey").alias("code"), F.concat_ws(" ", "r_name", "n_name").alias("name"), F.lpad(F.col("n_regionkey").cast("string"), 5, "0").alias("sgg"),
        F.col("n_nationkey").alias("ordinal"), lat.alias("lat"), lng.alias("lng"), (10.0 + F.col("n_nationkey") % 7).alias("area_km2"),
    )


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, name, type, code, lat, lng``; grows with the data."""
    lat, lng = _place("s_suppkey", 7919, 104729)
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))  # 25 rows at any scale
    kind = F.element_at(F.array(*map(F.lit, FACILITY_TYPES)), (F.col("s_suppkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), kind.alias("type"), _code("n_regionkey", "n_nationkey").alias("code"), lat.alias("lat"), lng.alias("lng"))


def _customer_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))  # 25 rows at any scale
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", _code("n_regionkey", "n_nationkey").alias("code"))


def _month_no(ts: str):
    return F.year(ts) * 12 + F.month(ts) - 1


def monthly_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``code, month_no, rev, qty, n, ratio``: line items by the customer's cell and order month; cells may lack months.

    Line items are summed to orders first, so that the joins move one row an order.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"), F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", _month_no("o_orderdate").alias("month_no"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(_customer_codes(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("code", "month_no").agg(F.sum("rev").alias("rev"), F.sum("qty").alias("qty"), F.sum("n").alias("n")).withColumn("ratio", F.col("rev") / F.col("n"))


def region_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """13 months of each cell: ``code, month_no, month`` and counts; ``one_person`` is null where it would be 0."""
    orders = table(spark, sf_dir, "orders").withColumn("month_no", _month_no("o_orderdate")).filter(F.col("month_no").between(FIRST_MONTH, LAST_MONTH))
    joined = orders.join(_customer_codes(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    counted = joined.groupBy("code", "month_no").agg(
        F.count_distinct("o_custkey").alias("population"), F.count(F.lit(1)).alias("households"), F.count_if(priority == "1-URGENT").alias("elderly"),
        F.count_if(priority == "5-LOW").alias("youth"), F.nullif(F.count_if(status == "P"), F.lit(0)).alias("one_person"), F.count_if(status == "O").alias("births"), F.count_if(status == "F").alias("deaths"),
    )
    return counted.withColumn("month", month_label(F.col("month_no"))).withColumn("working", F.col("households") - F.col("elderly") - F.col("youth"))


# The same bindings as common table expressions for the oracle.
_CODE = "lpad({r}::VARCHAR, 5, '0') || lpad({n}::VARCHAR, 5, '0')"
CTE = {
    "cells": f"cells AS (SELECT {_CODE.format(r='n_regionkey', n='n_nationkey')} AS code, r_name || ' ' || n_name AS name, lpad(n_regionkey::VARCHAR, 5, '0') AS sgg, n_nationkey AS ordinal, "
    "34.5 + (n_nationkey * 613 % 1400) / 1000.0::DOUBLE AS lat, 127.5 + (n_nationkey * 1027 % 1800) / 1000.0::DOUBLE AS lng, 10.0::DOUBLE + n_nationkey % 7 AS area_km2 FROM nation JOIN region ON n_regionkey = r_regionkey)",
    "facilities": f"facilities AS (SELECT s_suppkey AS id, s_name AS name, ['hospital','clinic','dental','oriental','care','center','public','pharmacy'][s_suppkey % 8 + 1] AS type, "
    f"{_CODE.format(r='n_regionkey', n='n_nationkey')} AS code, 34.5 + (s_suppkey * 7919 % 1400) / 1000.0::DOUBLE AS lat, 127.5 + (s_suppkey * 104729 % 1800) / 1000.0::DOUBLE AS lng FROM supplier JOIN nation ON s_nationkey = n_nationkey)",
    "cube": f"cube AS (SELECT {_CODE.format(r='n_regionkey', n='n_nationkey')} AS code, (year(o_orderdate) * 12 + month(o_orderdate) - 1)::INT AS month_no, sum(l_extendedprice * (1 - l_discount)) AS rev, sum(l_quantity) AS qty, "
    "count(*) AS n, sum(l_extendedprice * (1 - l_discount)) / count(*) AS ratio FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)",
    "series": f"series AS (SELECT *, lpad((month_no // 12)::VARCHAR, 4, '0') || '-' || lpad((month_no % 12 + 1)::VARCHAR, 2, '0') AS month, households - elderly - youth AS working FROM (SELECT {_CODE.format(r='n_regionkey', n='n_nationkey')} AS code, "
    "(year(o_orderdate) * 12 + month(o_orderdate) - 1)::INT AS month_no, count(DISTINCT o_custkey) AS population, count(*) AS households, count(*) FILTER (o_orderpriority = '1-URGENT') AS elderly, "
    "count(*) FILTER (o_orderpriority = '5-LOW') AS youth, nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS one_person, count(*) FILTER (o_orderstatus = 'O') AS births, count(*) FILTER (o_orderstatus = 'F') AS deaths "
    "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE year(o_orderdate) * 12 + month(o_orderdate) - 1 BETWEEN 24006 AND 24018 GROUP BY 1, 2))",
}


def with_ctes(names: str, body: str) -> str:
    """``body`` with the named bindings before it."""
    own = body.removeprefix("WITH ")
    return "WITH " + ", ".join(CTE[n] for n in names.split()) + (", " + own if body.startswith("WITH ") else " " + body)
