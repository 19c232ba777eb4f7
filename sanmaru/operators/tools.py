"""The named analyses of region series and facilities. Each returns ``code, score`` and its metrics, ranked.

Scores are rounded half up to two digits before they are ranked; ties go by code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sanmaru.functions.numeric import half_up, percentage, sum_or_null, vulnerability
from sanmaru.operators.access import access, nearest, within_radius
from sanmaru.operators.cube import rank_rows, winsor_scores

#: Radius of the vulnerability index in km, and the radii that may be asked for.
INDEX_KM, LEAST_KM, MOST_KM = 2.0, 1.0, 3.0


def year_change(series: DataFrame, month_no: int) -> DataFrame:
    """``code`` with the reference month's counts and those of 12 months before (``was_*``)."""
    now = series.filter(F.col("month_no") == month_no)
    was = series.filter(F.col("month_no") == month_no - 12).select("code", F.col("population").alias("was_population"), F.col("elderly").alias("was_elderly"))
    return now.join(was, "code", "left")


def _ranked(rows: DataFrame, score, descending: bool = True, keep_null: bool = False, *metrics) -> DataFrame:
    return rank_rows(rows.select("code", half_up(score, 2).alias("score"), *metrics), "score", descending, keep_null=keep_null)


def scarcity(series: DataFrame, cells: DataFrame, facilities: DataFrame, month_no: int) -> DataFrame:
    """Vulnerability index of density, elderly ratio, distance and count (few facilities score high)."""
    now = series.filter(F.col("month_no") == month_no).join(cells, "code").join(access(cells, facilities, INDEX_KM), "code")
    rows = now.withColumn("density", F.col("population") / F.col("area_km2")).withColumn("ratio", percentage(F.col("elderly"), F.col("population"))).withColumn("count", F.col("within").cast("double"))
    rows = winsor_scores(rows, *[(v, f"s_{v}", v == "count") for v in ("density", "ratio", "nearest_km", "count")])
    index = vulnerability(F.col("s_density"), F.col("s_ratio"), F.col("s_nearest_km"), F.col("s_count"))
    return _ranked(rows, index, True, True, half_up(F.col("nearest_km"), 2).alias("nearest_km"), "within")


def elderly_underserved(series: DataFrame, cells: DataFrame, facilities: DataFrame, month_no: int) -> DataFrame:
    rows = series.filter(F.col("month_no") == month_no).join(access(cells, facilities, INDEX_KM), "code")
    return _ranked(rows, percentage(F.col("elderly"), F.col("population")), True, False, half_up(F.col("nearest_km"), 2).alias("nearest_km"), "within", "own")


def elderly_trend(series: DataFrame, month_no: int, sign: int = 1) -> DataFrame:
    rows = year_change(series, month_no)
    return _ranked(rows, sign * (percentage(F.col("elderly"), F.col("population")) - percentage(F.col("was_elderly"), F.col("was_population"))))


def population_trend(series: DataFrame, month_no: int, sign: int = 1) -> DataFrame:
    rows = year_change(series, month_no)
    return _ranked(rows, sign * percentage(F.col("population") - F.col("was_population"), F.col("was_population")), True, False, "population")


def at_reference(score: Callable, *metrics) -> Callable[[DataFrame, int], DataFrame]:
    """A ranking, highest first, of one expression at the reference month."""
    return lambda series, month_no: _ranked(series.filter(F.col("month_no") == month_no), score(), True, False, *[m() for m in metrics])


def _per_10k(part: str, name: str):
    return lambda: half_up(F.when(F.col("population") > 0, F.col(part) / F.col("population") * 10000), 2).alias(name)


RANKINGS: dict[str, Callable[[DataFrame, int], DataFrame]] = {
    "rankSingleHouseholdRisk": at_reference(lambda: percentage(F.col("one_person"), F.col("households"))),
    "rankDeathCount": at_reference(lambda: F.col("deaths").cast("double"), _per_10k("deaths", "per_10k")),
    "rankBirthCount": at_reference(lambda: F.col("births").cast("double"), _per_10k("births", "per_10k")),
    "rankHouseholdCount": at_reference(lambda: F.col("households").cast("double"), lambda: half_up(F.try_divide("population", "households"), 2).alias("per_household")),
    "rankNaturalDecrease": at_reference(lambda: (F.col("deaths") - F.col("births")).cast("double")),
    "rankNaturalIncrease": at_reference(lambda: (F.col("births") - F.col("deaths")).cast("double")),
    "rankPopulationSize": at_reference(lambda: F.col("population").cast("double")),
    "rankElderlyRatio": at_reference(lambda: percentage(F.col("elderly"), F.col("population"))),
}


def density_ranking(series: DataFrame, cells: DataFrame, month_no: int) -> DataFrame:
    rows = series.filter(F.col("month_no") == month_no).join(cells.select("code", "area_km2"), "code")
    return _ranked(rows, F.col("population") / F.col("area_km2"))


def nearest_ranking(cells: DataFrame, facilities: DataFrame, descending: bool = True) -> DataFrame:
    rows = nearest(cells, facilities)
    return _ranked(rows, F.col("nearest_km"), descending, True)


def radius_ranking(cells: DataFrame, facilities: DataFrame, km: float = 2.0) -> DataFrame:
    if not LEAST_KM <= km <= MOST_KM:
        raise ValueError(f"the radius is from {LEAST_KM} to {MOST_KM} km")
    rows = cells.select("code").join(within_radius(cells, facilities, km), "code", "left")
    return _ranked(rows, F.coalesce("within", F.lit(0)).cast("double"), False)


def compare_districts(series: DataFrame, facilities: DataFrame, districts: list[str], month_no: int) -> DataFrame:
    """Sums and ratios of sums of each district, fewest facilities per 10,000 first; pharmacies don't count."""
    now = series.filter((F.col("month_no") == month_no) & F.substring("code", 1, 5).isin(districts)).withColumn("sgg", F.substring("code", 1, 5))
    sums = now.groupBy("sgg").agg(F.sum("population").alias("population"), F.sum("elderly").alias("elderly"), sum_or_null(F.col("one_person")).alias("one_person"), F.sum("households").alias("households"))
    places = facilities.filter("type <> 'pharmacy'").groupBy(F.substring("code", 1, 5).alias("sgg")).agg(F.count(F.lit(1)).alias("facilities"))
    rows = sums.join(places, "sgg", "left").withColumn("facilities", F.coalesce("facilities", F.lit(0))).withColumnRenamed("sgg", "code")
    per = F.when(F.col("population") > 0, F.col("facilities") / F.col("population") * 10000)
    return _ranked(rows, per, False, True, "population", half_up(percentage(F.col("elderly"), F.col("population")), 2).alias("elderly_ratio"), half_up(percentage(F.col("one_person"), F.col("households")), 2).alias("one_person_ratio"), "facilities")


def region_detail(series: DataFrame, cells: DataFrame, month_no: int, district: str | None = None) -> DataFrame:
    """Six metrics of each cell, or of one district as ratios of sums (one-person households skip unknown members)."""
    now = series.filter(F.col("month_no") == month_no).join(cells.select("code", "area_km2"), "code")
    if district is not None:
        own = now.filter(F.substring("code", 1, 5) == district)
        now = own.agg(F.lit(district).alias("code"), *[F.sum(c).alias(c) for c in ("population", "households", "elderly", "one_person", "births", "deaths", "area_km2")])
    return now.select(
        "code", "population", "households", half_up(percentage(F.col("elderly"), F.col("population")), 2).alias("elderly_ratio"), half_up(percentage(F.col("one_person"), F.col("households")), 2).alias("one_person_ratio"),
        half_up(F.col("population") / F.col("area_km2"), 2).alias("density"), (F.col("births") - F.col("deaths")).alias("natural_change"),
    )


def roll_up_series(series: DataFrame, cells: DataFrame) -> DataFrame:
    """Districts of region series: sums (one-person null if a member's is), density anew, population-weighted point."""
    rows = series.join(cells.select("code", "lat", "lng", "area_km2"), "code").withColumn("sgg", F.substring("code", 1, 5))
    w = F.col("population")
    return rows.groupBy("sgg", "month_no").agg(
        *[F.sum(c).alias(c) for c in ("population", "households", "elderly", "births", "deaths")], sum_or_null(F.col("one_person")).alias("one_person"),
        (F.sum("population") / F.sum("area_km2")).alias("density"), (F.sum(F.col("lat") * w) / F.nullif(F.sum(w), F.lit(0))).alias("lat"), (F.sum(F.col("lng") * w) / F.nullif(F.sum(w), F.lit(0))).alias("lng"),
    )
