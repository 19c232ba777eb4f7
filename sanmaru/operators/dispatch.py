"""Many analysis intents at once: checked, run as one plan over shared sub-plans, ranked for each intent."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sanmaru.functions.numeric import half_up
from sanmaru.operators import tools as T
from sanmaru.operators.access import access_pairs, nearest
from sanmaru.session import broadcast_upto, written

#: What a region is called at each level.
LEVELS = {"dong": "행정동", "sgg": "시군구"}
#: Bounds of an intent's fields.
MOST_ROWS, MOST_REGIONS, DEFAULT_ROWS, DEFAULT_KM = 600, 10, 10, 2.0
#: Tools that read region series only, and those that read facilities.
SERIES_TOOLS: dict[str, Callable[[DataFrame, int], DataFrame]] = {
    **T.RANKINGS,
    "rankElderlyRatioTrend": lambda s, m: T.elderly_trend(s, m, 1), "rankElderlyRatioDecline": lambda s, m: T.elderly_trend(s, m, -1),
    "rankPopulationGrowthPressure": lambda s, m: T.population_trend(s, m, 1), "rankPopulationDeclineRisk": lambda s, m: T.population_trend(s, m, -1),
}
ACCESS_TOOLS = ("nearestFacilityDistance", "countFacilitiesWithinRadius")
TOOLS = (*SERIES_TOOLS, "rankPopulationDensity", *ACCESS_TOOLS)
#: Tools that list the smallest first unless an intent says otherwise.
ASCENDING = ("countFacilitiesWithinRadius",)


def intent_faults(intents: DataFrame, cells: DataFrame) -> DataFrame:
    """``id, fault``: a row for each thing wrong with an intent; a code that comes twice among the cells is a fault of all intents.

    ``intents(id, tool, level, radius_km, limit, direction, regions)``; all but ``id`` and ``tool`` may be null.
    """
    outside = lambda c, low, high: F.col(c).isNotNull() & ~F.coalesce(F.col(c).between(low, high), F.lit(False))
    checks = {
        "unknown tool": ~F.coalesce(F.col("tool").isin(*TOOLS), F.lit(False)), "unknown level": F.col("level").isNotNull() & ~F.col("level").isin(*LEVELS),
        "radius": outside("radius_km", T.LEAST_KM, T.MOST_KM) | F.isnan("radius_km"), "limit": outside("limit", 1, MOST_ROWS),
        "direction": F.col("direction").isNotNull() & ~F.col("direction").isin("ascending", "descending"), "regions": F.coalesce((F.size("regions") > MOST_REGIONS) | F.exists("regions", lambda r: ~F.coalesce(F.length(r).between(1, 50), F.lit(False))), F.lit(False)),
    }
    listed = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))
    repeated = cells.groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.concat(F.lit("repeated code "), "code").alias("fault"))
    return intents.select("id", F.explode(listed).alias("fault")).union(intents.select("id").crossJoin(repeated))


def _districts(series: DataFrame, cells: DataFrame, month_no: int) -> tuple[DataFrame, DataFrame]:
    """Series and cells of districts; the place of a district is that of its people at the reference month."""
    rolled = written(T.roll_up_series(series, cells).withColumnRenamed("sgg", "code"))
    area = cells.groupBy(F.substring("code", 1, 5).alias("code")).agg(F.sum("area_km2").alias("area_km2"), F.min(F.substring_index("name", " ", 1)).alias("name"))
    return rolled, rolled.filter(F.col("month_no") == month_no).select("code", "lat", "lng").join(area, "code")


def tool_scores(series: DataFrame, cells: DataFrame, facilities: DataFrame, radii: DataFrame, month_no: int, level: str) -> DataFrame:
    """``level, tool, radius_km, code, score`` of all tools; ``radius_km`` is null but for counts within the ``radii``.

    Series and the pairs of near facilities are read from one table each, whatever the number of tools and radii.
    """
    parts = [f(series, month_no).select(F.lit(t).alias("tool"), F.lit(None).cast("double").alias("radius_km"), "code", "score") for t, f in SERIES_TOOLS.items()]
    named = lambda df, t: df.select(F.lit(t).alias("tool"), F.lit(None).cast("double").alias("radius_km"), "code", "score")
    parts.append(named(T.density_ranking(series, cells, month_no), "rankPopulationDensity"))
    parts.append(named(nearest(cells, facilities).select("code", half_up(F.col("nearest_km"), 2).alias("score")), "nearestFacilityDistance"))
    near = access_pairs(cells, facilities, T.MOST_KM)  # ``radii`` are bounded by their metres
    counts = near.join(F.broadcast(radii), F.col("km") <= F.col("radius_km")).groupBy("code", "radius_km").agg(F.count(F.lit(1)).alias("n"))
    every = cells.select("code").crossJoin(F.broadcast(radii)).join(counts, ["code", "radius_km"], "left")
    parts.append(every.select(F.lit("countFacilitiesWithinRadius").alias("tool"), "radius_km", "code", F.coalesce("n", F.lit(0)).cast("double").alias("score")))
    return reduce(DataFrame.unionByName, parts).withColumn("level", F.lit(level))


def run_intents(intents: DataFrame, series: DataFrame, cells: DataFrame, facilities: DataFrame, month_no: int) -> tuple[DataFrame, DataFrame]:
    """``id, tool, level, rank, code, score`` of all intents without faults, and the ``id, fault`` of the others.

    ``level`` is the word for a region at the intent's level. Regions of an intent (codes, or names that hold them, blanks
    aside) limit its rows. Rows without a score are left out; ties go by code. Radii count to the metre, so there are at most
    2,001 of them, whatever the number of intents. ``id`` is unique.
    """
    faults = written(intent_faults(intents, cells))
    fine = intents.join(faults.select("id").distinct(), "id", "left_anti")
    descending = F.coalesce(F.col("direction") == "descending", ~F.col("tool").isin(*ASCENDING))
    counts = F.col("tool") == "countFacilitiesWithinRadius"
    fine = fine.select("id", "tool", F.coalesce("level", F.lit("dong")).alias("level"), F.when(counts, F.round(F.coalesce("radius_km", F.lit(DEFAULT_KM)), 3)).alias("radius_km"), F.coalesce("limit", F.lit(DEFAULT_ROWS)).alias("limit"), descending.alias("descending"), "regions")
    fine = written(fine)
    radii = fine.filter("radius_km is not null").select("radius_km").distinct()
    radii = written(radii)
    series = written(series)
    levels = {"dong": (series, cells.select("code", "name", "lat", "lng", "area_km2")), "sgg": _districts(series, cells, month_no)}
    scores = reduce(DataFrame.unionByName, [tool_scores(s, c, facilities, radii, month_no, level).join(c.select("code", F.regexp_replace("name", r"\s+", "").alias("name")), "code") for level, (s, c) in levels.items()])
    scores = written(scores.filter("score is not null"))
    asked = fine.withColumnRenamed("radius_km", "km_")
    same = (scores["tool"] == asked["tool"]) & (scores["level"] == asked["level"]) & scores["radius_km"].eqNullSafe(asked["km_"])
    rows = asked.join(broadcast_upto(scores, 500_000), same).select("id", asked["tool"], asked["level"], "limit", "descending", "regions", "code", "name", "score")
    wanted = F.coalesce(F.size("regions") < 1, F.lit(True)) | F.coalesce(F.exists("regions", lambda r: (F.col("code") == r) | F.contains(F.col("name"), F.regexp_replace(r, r"\s+", ""))), F.lit(False))
    order = F.when(F.col("descending"), -F.col("score")).otherwise(F.col("score"))
    ranked = rows.filter(wanted).withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(order, "code"))).filter(F.col("rank") <= F.col("limit"))
    label = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.col("level")]
    return ranked.select("id", "tool", label.alias("level"), "rank", "code", "score"), faults
