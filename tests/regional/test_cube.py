"""Operators of the cube on small tables with values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from sanmaru.functions.numeric import half_up, vulnerability
from sanmaru.operators import cube as C


def cube(spark, rows, metrics="v double"):
    return spark.createDataFrame(rows, f"code string, month_no int, {metrics}")


def test_half_up_goes_toward_plus_infinity(spark):
    rows = spark.createDataFrame([(-2.5,), (2.5,), (1.005,), (None,)], "v double").select(half_up(F.col("v"), 0).alias("r")).collect()
    assert [r.r for r in rows] == [-2.0, 3.0, 1.0, None]


def test_roll_up(spark):
    rows = cube(spark, [("4812051000", 1, 100.0, 20.0), ("4812052000", 1, 300.0, 40.0), ("4817051000", 1, 50.0, 10.0), ("4900000000", 1, 0.0, 20.0), ("4900100000", 1, None, 5.0)], "pop double, ratio double")
    got = {r.code: (r.pop, r.ratio) for r in C.roll_up(rows, ["pop"], {"ratio": "pop"}).collect()}
    assert got["48120"] == (400.0, 35.0) and got["48170"] == (50.0, 10.0)
    assert got["49000"] == (0.0, None) and got["49001"] == (0.0, None)


def test_cross_gap(spark):
    a = spark.createDataFrame([("1", 10.0), ("2", 20.0), ("3", 30.0), ("4", None)], "code string, a double")
    b = spark.createDataFrame([("1", 30.0), ("2", 20.0), ("3", 10.0), ("5", 1.0)], "code string, b double")
    got = {r.code: round(r.score, 9) for r in C.cross(a, b, -1).collect()}
    assert got == {"1": 0.0, "2": 50.0, "3": 100.0}


def test_single_row_scores_fifty(spark):
    assert [r.score for r in C.min_max_scores(spark.createDataFrame([("1", 7.0)], "code string, v double"), "v").collect()] == [50.0]


@pytest.mark.parametrize(
    ("values", "change", "direction", "slope"),
    [([100, 110, 120, 130], 30.0, "rising", 10.0), ([100, None, None, 130], 30.0, "rising", 10.0), ([-100, -50], 50.0, "rising", 50.0), ([0, 5, 10], None, "rising", 5.0), ([100, 101, 99, 102], 2.0, "flat", 0.4), ([5, None], None, None, None)],
)
def test_trend(spark, values, change, direction, slope):
    rows = cube(spark, [("1", i, None if v is None else float(v)) for i, v in enumerate(values)])
    r = C.trends(rows, "v").first()
    assert r.direction == direction
    if len([v for v in values if v is not None]) > 1:
        assert r.change == change or abs(r.change - change) < 1e-9
        assert abs(r.slope - slope) < 1e-9


def test_recent_counts_calendar_months(spark):
    rows = cube(spark, [("1", m, float(m)) for m in (2, 5, 8, 11)])
    assert sorted(r.month_no for r in C.recent(rows, 3).collect()) == [11]
    assert sorted(r.month_no for r in C.recent(rows, 6).collect()) == [8, 11]


def test_trend_ranking_scores(spark):
    rows = cube(spark, [(c, m, v) for c, a, b in (("1", 100.0, 130.0), ("2", 100.0, 100.0), ("3", 100.0, 70.0), ("4", 0.0, 9.0)) for m, v in ((0, a), (1, b))])
    got = [(r.code, round(r.score, 6), r["rank"]) for r in C.trend_ranking(rows, "v").orderBy("rank").collect()]
    assert got == [("1", 100.0, 1), ("2", 50.0, 2), ("3", 0.0, 3)]


def test_percentile_rank_takes_the_upper_rank_of_ties(spark):
    rows = spark.createDataFrame([("a", 10.0), ("b", 20.0), ("c", 20.0), ("d", 30.0), ("e", None)], "code string, v double").withColumn("g", F.lit(1))
    got = {r.code: r.percentile for r in C.percentile_ranks(rows, "v", ["g"]).collect()}
    assert got["a"] == 0.0 and got["d"] == 100.0 and abs(got["b"] - 200 / 3) < 1e-9 and got["b"] == got["c"] and got["e"] is None
    one = spark.createDataFrame([("a", 1.0)], "code string, v double").withColumn("g", F.lit(1))
    assert C.percentile_ranks(one, "v", ["g"]).first().percentile is None


def test_winsor(spark):
    rows = spark.createDataFrame([("a", 0.0), ("b", None), ("c", 10.0)], "code string, v double")
    assert [r.s for r in C.winsor_scores(rows, ("v", "s", False)).orderBy("code").collect()] == [0.0, None, 100.0]
    assert [r.s for r in C.winsor_scores(rows, ("v", "s", True)).orderBy("code").collect()] == [100.0, None, 0.0]
    flat = spark.createDataFrame([("a", 3.0), ("b", 3.0)], "code string, v double")
    assert {r.s for r in C.winsor_scores(flat, ("v", "s", True)).collect()} == {0.0}


def test_breaks_and_bins(spark):
    rows = spark.createDataFrame([(float(v),) for v in (0, 25, 50, 75, 100)], "v double")
    got = C.color_bins(rows, "v").orderBy("v").collect()
    assert [round(b, 6) for b in got[0].breaks] == [20, 40, 60, 80] and [r.bin for r in got] == [0, 1, 2, 3, 4]


def test_index_is_null_if_a_part_is(spark):
    rows = spark.createDataFrame([(100.0, 60.0, 40.0, 100.0), (100.0, None, 40.0, 100.0)], "a double, b double, c double, d double")
    assert [r.v for r in rows.select(vulnerability(*map(F.col, "abcd")).alias("v")).collect()] == [75.0, None]


def test_ranking_keeps_nulls_last_and_breaks_ties(spark):
    rows = spark.createDataFrame([("c", 1.0), ("a", 1.0), ("b", None), ("d", 2.0)], "code string, v double")
    assert [r.code for r in C.rank_rows(rows, "v").orderBy("rank").collect()] == ["d", "a", "c", "b"]
    assert [r.code for r in C.rank_rows(rows, "v", descending=False, keep_null=False, limit=2).orderBy("rank").collect()] == ["a", "c"]


def test_threshold_never_takes_null_or_nan(spark):
    rows = spark.createDataFrame([(1.0,), (None,), (math.nan,), (3.0,)], "v double")
    assert [r.v for r in C.threshold(rows, "v", ">=", 1).orderBy("v").collect()] == [1.0, 3.0]
    assert C.threshold(rows, "v", "<", 2).count() == 1


def test_percentiles_of_values_that_differ_between_runs(spark):
    """Sums of floats worked out twice can differ; each row must still find its own rank."""
    import random

    noise = F.udf(lambda v: v + random.random() * 0.5, "double").asNondeterministic()
    rows = spark.range(1, 41).select(F.lit("g").alias("g"), F.col("id").alias("n"), noise(F.col("id").cast("double")).alias("v"))
    got = {r.n: r.percentile for r in C.percentile_ranks(rows, "v", ["g"]).collect()}
    assert got == {n: (n - 1) / 39 * 100 for n in range(1, 41)}
    cube = spark.range(1, 41).select(F.lpad(F.col("id").cast("string"), 10, "0").alias("code"), F.lit(5).alias("month_no"), noise(F.col("id").cast("double")).alias("m"))
    assert C.profile(cube, ["m"], "0000000040", 5).first().percentile == 100.0
