"""The monthly snapshot of regions: five feeds joined by region and month, with a ledger of every fault."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sanmaru.session import written

#: Values of each feed; ``one_person`` may be missing and stays null, the others are required.
FEEDS = {"resident": ("population", "households"), "ages": ("youth", "working", "elderly"), "one_person": ("one_person",), "births": ("births",), "deaths": ("deaths",)}
OPTIONAL = ("one_person",)
KEYS = ["code", "month_no"]


def summed(feed: DataFrame, name: str) -> DataFrame:
    """A row for each region and month of a feed: sums of its values, and ``rows`` without some value in ``bad_<name>``."""
    values = FEEDS[name]
    blank = reduce(lambda a, b: a | b, [F.col(v).isNull() for v in values])
    return feed.groupBy(*KEYS).agg(*[F.sum(v).alias(v) for v in values], F.count_if(blank).alias(f"bad_{name}"))


def common_months(joined: DataFrame, n: int) -> DataFrame:
    """``month_no, place``: the latest ``n`` months in which every required feed has rows; places count back from 1."""
    have = [F.max(F.col(f"bad_{f}").isNotNull()).alias(f) for f in FEEDS if f not in OPTIONAL]
    months = joined.groupBy("month_no").agg(*have).filter(" and ".join(f for f in FEEDS if f not in OPTIONAL))
    return months.select("month_no", F.row_number().over(W.orderBy(F.desc("month_no"))).alias("place")).filter(F.col("place") <= n)  # months of a calendar


def normalize(regions: DataFrame, feeds: dict[str, DataFrame], n: int = 13) -> tuple[DataFrame, DataFrame]:
    """Snapshot rows and ledger.

    ``regions(code, area_km2)``; each feed has ``code, month_no`` and its values, with any number of rows for a region and
    month. Snapshot: ``n`` months of each region without faults, with density and natural change. Ledger: ``fault, feed,
    code, month_no``: *missing* (a required feed has no row), *blank* (a row without some value), *area* (no positive area),
    *repeated* (a region comes twice), *months* (fewer than ``n`` common months, or a gap after ``month_no``). With a fault of
    months there is no snapshot at all. Rows of other regions are passed over.
    """
    joined = written(reduce(lambda a, b: a.join(b, KEYS, "full_outer"), [summed(feeds[f], f) for f in FEEDS]))
    months = written(common_months(joined, n))
    counted = regions.groupBy("code").agg(F.count(F.lit(1)).alias("n_"), F.max("area_km2").alias("area_km2"))
    grid = written(counted.crossJoin(F.broadcast(months)).join(joined, KEYS, "left"))  # at most n months

    none, text = F.lit(None), lambda s: F.lit(s).alias("fault")
    kinds = []
    for f in FEEDS:
        if f not in OPTIONAL:
            kinds.append(F.when(F.col(f"bad_{f}").isNull(), F.struct(F.lit("missing").alias("fault"), F.lit(f).alias("feed"))))
        kinds.append(F.when(F.col(f"bad_{f}") > 0, F.struct(F.lit("blank").alias("fault"), F.lit(f).alias("feed"))))
    by_month = grid.select("code", "month_no", F.explode(F.array_compact(F.array(*kinds))).alias("k")).select("k.fault", "k.feed", "code", "month_no")
    area = counted.filter(~F.coalesce(F.col("area_km2") > 0, F.lit(False))).select(text("area"), none.cast("string").alias("feed"), "code", none.cast("int").alias("month_no"))
    twice = counted.filter("n_ > 1").select(text("repeated"), none.cast("string").alias("feed"), "code", none.cast("int").alias("month_no"))
    gap = months.withColumn("before_", F.lead("month_no").over(W.orderBy("place"))).filter("before_ <> month_no - 1").select(F.col("before_").alias("month_no"))
    few = months.agg(F.count(F.lit(1)).alias("n_")).filter(F.col("n_") < n).select(none.cast("int").alias("month_no"))
    calendar = written(gap.unionByName(few).select(text("months"), none.cast("string").alias("feed"), none.cast("string").alias("code"), F.col("month_no").cast("int").alias("month_no")))
    ledger = written(by_month.unionByName(area).unionByName(twice).withColumn("month_no", F.col("month_no").cast("int"))).unionByName(calendar)

    faulty = ledger.filter("code is not null").select("code").distinct()
    broken = calendar.agg((F.count(F.lit(1)) == 0).alias("fine_"))
    sound = grid.join(faulty, "code", "left_anti").crossJoin(F.broadcast(broken)).filter("fine_")
    rows = sound.select("code", "month_no", "population", "households", (F.col("population") / F.col("area_km2")).alias("density"), "youth", "working", "elderly", "one_person", "births", "deaths", (F.col("births") - F.col("deaths")).alias("natural_change"))
    return rows, ledger
