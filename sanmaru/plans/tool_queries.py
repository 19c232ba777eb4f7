"""Queries of the named analyses, the access joins and facility filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from sanmaru.functions import geo
from sanmaru.functions.numeric import half_up, sum_as_zero, sum_or_null
from sanmaru.operators import access as A
from sanmaru.operators import tools as T
from sanmaru.plans.cube_queries import r6, sql6
from sanmaru.plans.registry import query
from sanmaru.sources.bindings import cells, facilities, region_series, with_ctes

REF = 2001 * 12 + 6
H2 = "floor(({0}) * 100 + 0.5) / 100"
_KM = "2 * 6371.0088 * atan2(sqrt({h}), sqrt(1 - ({h})))".replace("{h}", "pow(sin(radians(f.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(f.lat)) * pow(sin(radians(f.lng - c.lng) / 2), 2)")
_KM = _KM.replace("radians(f.lat - c.lat)", "(radians(f.lat) - radians(c.lat))")
DIST = f"dist AS (SELECT c.code, f.id, f.code AS f_code, f.type, {_KM} AS km FROM cells c CROSS JOIN facilities f)"
ACCESS = DIST + ", acc AS (SELECT code, min(km) AS nearest_km, count(*) FILTER (km <= 2) AS within, count(*) FILTER (f_code = code) AS own FROM dist GROUP BY code)"


def ranking_sql(score: str, extra: str = "", source: str = "series WHERE month_no = 24018", desc: bool = True, keep_null: bool = False, ctes: str = "series", before: str = "") -> str:
    order = ("DESC" if desc else "ASC") + " NULLS LAST"
    inner = f"SELECT code, {H2.format(score)} AS score{extra} FROM {source}"
    return with_ctes(ctes, f"WITH {before}{', ' if before else ''}r AS ({inner}) SELECT *, row_number() OVER (ORDER BY score {order}, code)::INT AS rank FROM r" + ("" if keep_null else " WHERE score IS NOT NULL"))


_RATIO = "CASE WHEN {b} > 0 THEN {a} / {b} * 100 END"
_SQL = {
    "rankSingleHouseholdRisk": (_RATIO.format(a="one_person", b="households"), ""),
    "rankDeathCount": ("deaths::DOUBLE", ", " + H2.format("CASE WHEN population > 0 THEN deaths / population * 10000 END") + " AS per_10k"),
    "rankBirthCount": ("births::DOUBLE", ", " + H2.format("CASE WHEN population > 0 THEN births / population * 10000 END") + " AS per_10k"),
    "rankHouseholdCount": ("households::DOUBLE", ", " + H2.format("population / nullif(households, 0)") + " AS per_household"),
    "rankNaturalDecrease": ("(deaths - births)::DOUBLE", ""),
    "rankNaturalIncrease": ("(births - deaths)::DOUBLE", ""),
    "rankPopulationSize": ("population::DOUBLE", ""),
    "rankElderlyRatio": (_RATIO.format(a="elderly", b="population"), ""),
}
for _name, (_score, _extra) in _SQL.items():
    query(_name, ranking_sql(_score, _extra))(lambda spark, d, f=T.RANKINGS[_name]: f(region_series(spark, d), REF))

_YEAR = "(SELECT a.*, b.population AS was_population, b.elderly AS was_elderly FROM series a LEFT JOIN series b ON a.code = b.code AND b.month_no = 24006 WHERE a.month_no = 24018)"
_PP = "CASE WHEN population > 0 THEN elderly / population * 100 END - CASE WHEN was_population > 0 THEN was_elderly / was_population * 100 END"
_PCT = "CASE WHEN was_population > 0 THEN (population - was_population) / was_population * 100 END"


@query("rankElderlyRatioTrend", ranking_sql(_PP, source=_YEAR))
def elderly_trend(spark, d):
    return T.elderly_trend(region_series(spark, d), REF)


@query("rankElderlyRatioDecline", ranking_sql(f"-({_PP})", source=_YEAR))
def elderly_decline(spark, d):
    return T.elderly_trend(region_series(spark, d), REF, -1)


@query("rankPopulationGrowthPressure", ranking_sql(_PCT, ", population", source=_YEAR))
def growth(spark, d):
    return T.population_trend(region_series(spark, d), REF)


@query("rankPopulationDeclineRisk", ranking_sql(f"-({_PCT})", ", population", source=_YEAR))
def decline(spark, d):
    return T.population_trend(region_series(spark, d), REF, -1)


@query("win_lag12_pct", with_ctes("series", f"SELECT code, {sql6(_PCT, 'change')} FROM {_YEAR}"))
def win_lag12_pct(spark, d):
    rows = T.year_change(region_series(spark, d), REF)
    return rows.select("code", r6(F.when(F.col("was_population") > 0, (F.col("population") - F.col("was_population")) / F.col("was_population") * 100), "change"))


@query("win_lag12_pp", with_ctes("series", f"SELECT code, {sql6(_PP, 'change')} FROM {_YEAR}"))
def win_lag12_pp(spark, d):
    from sanmaru.functions.numeric import percentage

    rows = T.year_change(region_series(spark, d), REF)
    return rows.select("code", r6(percentage(F.col("elderly"), F.col("population")) - percentage(F.col("was_elderly"), F.col("was_population")), "change"))


@query("rankPopulationDensity", ranking_sql("population / area_km2", source="series JOIN cells USING (code) WHERE month_no = 24018", ctes="series cells"))
def density(spark, d):
    return T.density_ranking(region_series(spark, d), cells(spark, d), REF)


def _w(v, name, inverted=False):
    share = f"(greatest(lo_{name}, least(hi_{name}, {v})) - lo_{name}) / nullif(hi_{name} - lo_{name}, 0) * 100"
    return f"CASE WHEN hi_{name} = lo_{name} THEN 0 ELSE {'100 - ' if inverted else ''}{share} END"


_BASE = ACCESS + ", base AS (SELECT code, population / area_km2 AS density, " + _RATIO.format(a="elderly", b="population") + " AS ratio, nearest_km, within FROM series JOIN cells USING (code) JOIN acc USING (code) WHERE month_no = 24018), lim AS (SELECT " + ", ".join(f"quantile_cont({v}, 0.05) AS lo_{n}, quantile_cont({v}, 0.95) AS hi_{n}" for v, n in (("density", "d"), ("ratio", "r"), ("nearest_km", "k"), ("within::DOUBLE", "c"))) + " FROM base)"


@query("rankHospitalScarcity", ranking_sql(f"greatest(0, least(100, 0.35 * {_w('density', 'd')} + 0.25 * {_w('ratio', 'r')} + 0.25 * {_w('nearest_km', 'k')} + 0.15 * {_w('within', 'c', True)}))", f", {H2.format('nearest_km')} AS nearest_km, within", "base, lim", keep_null=True, ctes="cells facilities series", before=_BASE))
def scarcity(spark, d):
    return T.scarcity(region_series(spark, d), cells(spark, d), facilities(spark, d), REF)


@query("rankElderlyUnderserved", ranking_sql(_RATIO.format(a="elderly", b="population"), f", {H2.format('nearest_km')} AS nearest_km, within, own", "series JOIN acc USING (code) WHERE month_no = 24018", ctes="cells facilities series", before=ACCESS))
def underserved(spark, d):
    return T.elderly_underserved(region_series(spark, d), cells(spark, d), facilities(spark, d), REF)


@query("nearestFacilityDistance", ranking_sql("nearest_km", source="acc", keep_null=True, ctes="cells facilities", before=ACCESS))
def nearest_tool(spark, d):
    return T.nearest_ranking(cells(spark, d), facilities(spark, d))


@query("countFacilitiesWithinRadius", ranking_sql("within::DOUBLE", source="acc", desc=False, ctes="cells facilities", before=ACCESS))
def radius_tool(spark, d):
    return T.radius_ranking(cells(spark, d), facilities(spark, d))


@query("join_nearest", with_ctes("cells facilities", f"WITH {DIST} SELECT code, {sql6('min(km)', 'nearest_km')} FROM dist WHERE type = 'hospital' GROUP BY code"))
def join_nearest(spark, d):
    return A.nearest(cells(spark, d), facilities(spark, d).filter("type = 'hospital'")).select("code", r6("nearest_km"))


@query("join_radius", with_ctes("cells facilities", f"WITH {DIST} SELECT code, count(*) AS within FROM dist WHERE km <= 10 GROUP BY code"))
def join_radius(spark, d):
    return A.within_radius(cells(spark, d), facilities(spark, d), 10)


@query("join_access_fused", with_ctes("cells facilities", f"WITH {ACCESS} SELECT code, {sql6('nearest_km', 'nearest_km')}, within, own FROM acc"))
def join_access_fused(spark, d):
    return A.access(cells(spark, d), facilities(spark, d), 2).select("code", r6("nearest_km"), "within", "own")


@query("join_facility_count", with_ctes("cells facilities", "SELECT c.code, count(f.id) AS facilities FROM cells c LEFT JOIN facilities f ON f.code = c.code GROUP BY 1"))
def join_facility_count(spark, d):
    own = facilities(spark, d).groupBy("code").agg(F.count(F.lit(1)).alias("facilities"))
    return cells(spark, d).select("code").join(own, "code", "left").select("code", F.coalesce("facilities", F.lit(0)).alias("facilities"))


@query("join_semi_facility", with_ctes("cells facilities", "SELECT id, code FROM facilities WHERE code IN (SELECT code FROM cells WHERE name LIKE 'ASIA%')"))
def join_semi_facility(spark, d):
    return facilities(spark, d).join(cells(spark, d).filter(F.col("name").startswith("ASIA")), "code", "left_semi").select("id", "code")


@query("join_semi_compare", with_ctes("facilities", "SELECT substr(code, 1, 5) AS sgg, count(*) AS facilities FROM facilities WHERE type <> 'pharmacy' GROUP BY 1"))
def join_semi_compare(spark, d):
    return facilities(spark, d).filter("type <> 'pharmacy'").groupBy(F.substring("code", 1, 5).alias("sgg")).agg(F.count(F.lit(1)).alias("facilities"))


_DISTRICT = (
    "WITH s AS (SELECT substr(code, 1, 5) AS code, sum(population)::BIGINT AS population, sum(elderly) AS elderly, CASE WHEN count(*) = count(one_person) THEN sum(one_person) END AS one_person, sum(households) AS households FROM series WHERE month_no = 24018 AND substr(code, 1, 5) IN ('00000', '00002', '00004') GROUP BY 1), "
    "f AS (SELECT substr(code, 1, 5) AS code, count(*) AS facilities FROM facilities WHERE type <> 'pharmacy' GROUP BY 1), j AS (SELECT s.*, coalesce(facilities, 0) AS facilities FROM s LEFT JOIN f USING (code)), "
    f"r AS (SELECT code, {H2.format('CASE WHEN population > 0 THEN facilities / population * 10000 END')} AS score, population, {H2.format(_RATIO.format(a='elderly', b='population'))} AS elderly_ratio, {H2.format(_RATIO.format(a='one_person', b='households'))} AS one_person_ratio, facilities FROM j) "
    "SELECT *, row_number() OVER (ORDER BY score ASC NULLS LAST, code)::INT AS rank FROM r"
)


@query("compareRegions", with_ctes("series facilities", _DISTRICT))
def compare(spark, d):
    return T.compare_districts(region_series(spark, d), facilities(spark, d), ["00000", "00002", "00004"], REF)


_DETAIL = f"{H2.format(_RATIO.format(a='elderly', b='population'))} AS elderly_ratio, {H2.format(_RATIO.format(a='one_person', b='households'))} AS one_person_ratio, {H2.format('population / area_km2')} AS density, births - deaths AS natural_change"


@query("getRegionDetails", with_ctes("series cells", f"SELECT code, population, households, {_DETAIL} FROM series JOIN cells USING (code) WHERE month_no = 24018"))
def details(spark, d):
    return T.region_detail(region_series(spark, d), cells(spark, d), REF)


@query("agg_group_detail", with_ctes("series cells", f"WITH g AS (SELECT '00002' AS code, sum(population)::BIGINT AS population, sum(households)::BIGINT AS households, sum(elderly)::BIGINT AS elderly, sum(one_person)::BIGINT AS one_person, sum(births)::BIGINT AS births, sum(deaths)::BIGINT AS deaths, sum(area_km2) AS area_km2 FROM series JOIN cells USING (code) WHERE month_no = 24018 AND substr(code, 1, 5) = '00002') SELECT code, population, households, {_DETAIL} FROM g"))
def agg_group_detail(spark, d):
    return T.region_detail(region_series(spark, d), cells(spark, d), REF, "00002")


@query("prj_detail", with_ctes("series cells", f"SELECT code, month_no, {sql6('population / area_km2', 'density')}, births - deaths AS natural_change FROM series JOIN cells USING (code)"))
def prj_detail(spark, d):
    rows = region_series(spark, d).join(cells(spark, d), "code")
    return rows.select("code", "month_no", r6(F.col("population") / F.col("area_km2"), "density"), (F.col("births") - F.col("deaths")).alias("natural_change"))


@query("agg_rollup_snapshot", with_ctes("series cells", f"SELECT substr(code, 1, 5) AS sgg, month_no, sum(population)::BIGINT AS population, sum(households)::BIGINT AS households, CASE WHEN count(*) = count(one_person) THEN sum(one_person)::BIGINT END AS one_person, {sql6('sum(population) / sum(area_km2)', 'density')}, floor(sum(lat * population) / nullif(sum(population), 0) * 1e4 + 0.5) / 1e4 AS lat FROM series JOIN cells USING (code) GROUP BY 1, 2"))
def agg_rollup_snapshot(spark, d):
    return T.roll_up_series(region_series(spark, d), cells(spark, d)).select("sgg", "month_no", "population", "households", "one_person", r6("density"), half_up(F.col("lat"), 4).alias("lat"))


@query("agg_sum_null_any", with_ctes("series", "SELECT month_no, CASE WHEN count(*) = count(one_person) THEN sum(one_person)::BIGINT END AS one_person FROM series GROUP BY 1"))
def agg_sum_null_any(spark, d):
    return region_series(spark, d).groupBy("month_no").agg(sum_or_null(F.col("one_person")).alias("one_person"))


@query("agg_sum_null_skip", with_ctes("series", "SELECT code, sum(one_person)::BIGINT AS one_person FROM series GROUP BY 1"))
def agg_sum_null_skip(spark, d):
    return region_series(spark, d).groupBy("code").agg(F.sum("one_person").alias("one_person"))


@query("agg_sum_series", with_ctes("series", "SELECT month, sum(coalesce(one_person, 0))::BIGINT AS one_person FROM series GROUP BY 1"))
def agg_sum_series(spark, d):
    return region_series(spark, d).groupBy("month").agg(sum_as_zero(F.col("one_person")).alias("one_person"))


@query("prj_pop_cube", with_ctes("series cells", f"SELECT code, month, population AS pop_total, households, {sql6('population / area_km2', 'density')}, births - deaths AS natural_change, {sql6('elderly / nullif(population, 0) * 100', 'elderly_ratio')} FROM series JOIN cells USING (code)"))
def prj_pop_cube(spark, d):
    rows = region_series(spark, d).join(cells(spark, d), "code")
    return rows.select("code", "month", F.col("population").alias("pop_total"), "households", r6(F.col("population") / F.col("area_km2"), "density"), (F.col("births") - F.col("deaths")).alias("natural_change"), r6(F.col("elderly") / F.nullif(F.col("population"), F.lit(0)) * 100, "elderly_ratio"))


@query("prj_medical_cube", ranking_sql(f"greatest(0, least(100, 0.35 * {_w('density', 'd')} + 0.25 * {_w('ratio', 'r')} + 0.25 * {_w('nearest_km', 'k')} + 0.15 * {_w('within', 'c', True)}))", "", "base, lim", keep_null=True, ctes="cells facilities series", before=_BASE).replace("SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, code)::INT AS rank FROM r", "SELECT code, population AS pop_total, score AS vulnerability FROM series LEFT JOIN r USING (code) WHERE month_no = 24018"))
def prj_medical_cube(spark, d):
    series = region_series(spark, d)
    index = T.scarcity(series, cells(spark, d), facilities(spark, d), REF).select("code", F.col("score").alias("vulnerability"))
    return series.filter(F.col("month_no") == REF).join(index, "code", "left").select("code", F.col("population").alias("pop_total"), "vulnerability")


@query("fn_haversine", with_ctes("cells facilities", f"WITH {DIST} SELECT code, id, {sql6('km', 'km')} FROM dist"))
def fn_haversine(spark, d):
    c, f = cells(spark, d).select("code", "lat", "lng"), facilities(spark, d).select("id", F.col("lat").alias("f_lat"), F.col("lng").alias("f_lng"))
    return f.crossJoin(F.broadcast(c)).select("code", "id", r6(geo.haversine_km(F.col("lat"), F.col("lng"), F.col("f_lat"), F.col("f_lng")), "km"))


_HOURS = "map_from_entries(array(struct('monday' AS k, concat(lpad(cast(id % 12 AS string), 2, '0'), ':00-', lpad(cast(12 + id % 11 AS string), 2, '0'), ':00') AS v), struct('saturday' AS k, CASE WHEN id % 3 = 0 THEN '09:00-13:00' ELSE '' END AS v)))"
_LATE = "(lpad((id % 12)::VARCHAR, 2, '0') < '06' OR 12 + id % 11 >= 20)"


def _open(spark, d):
    return facilities(spark, d).withColumn("hours", F.expr(_HOURS))


@query("flt_night", with_ctes("facilities", f"SELECT id FROM facilities WHERE {_LATE}"))
def flt_night(spark, d):
    return _open(spark, d).filter(A.night_open(F.col("hours"))).select("id")


@query("flt_weekend", with_ctes("facilities", "SELECT id FROM facilities WHERE id % 3 = 0"))
def flt_weekend(spark, d):
    return _open(spark, d).filter(A.weekend_open(F.col("hours"))).select("id")


@query("flt_facility", with_ctes("facilities cells", f"SELECT id, type FROM facilities WHERE type IN ('hospital', 'clinic', 'care') AND id % 3 = 0 AND {_LATE} AND code IN (SELECT code FROM cells WHERE contains(replace(name, ' ', ''), 'EUROPE'))"))
def flt_facility(spark, d):
    region = cells(spark, d).filter(F.regexp_replace("name", r"\s+", "").contains("EUROPE"))
    rows = _open(spark, d).filter(F.col("type").isin("hospital", "clinic", "care") & A.night_open(F.col("hours")) & A.weekend_open(F.col("hours")))
    return rows.join(region, "code", "left_semi").select("id", "type")


@query("filterFacilitiesByTypeAndHours", with_ctes("facilities cells", "SELECT f.id, f.name, type, c.name AS region FROM facilities f JOIN cells c USING (code) WHERE type <> 'pharmacy' AND id % 3 = 0"))
def filter_facilities(spark, d):
    rows = _open(spark, d).filter((F.col("type") != "pharmacy") & A.weekend_open(F.col("hours")))
    return rows.join(cells(spark, d).select("code", F.col("name").alias("region")), "code").select("id", "name", "type", "region")


@query("flt_facility_types", with_ctes("facilities", "SELECT type, count(*) AS n FROM facilities WHERE type <> 'pharmacy' GROUP BY 1"))
def flt_facility_types(spark, d):
    return facilities(spark, d).filter("type <> 'pharmacy'").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("flt_region_token", with_ctes("cells", "SELECT code, name FROM cells WHERE code = '0000200008' OR name = 'ASIA INDIA' OR contains(regexp_replace(name, '\\s+', '', 'g'), 'AFRICA')"))
def flt_region_token(spark, d):
    flat = F.regexp_replace("name", r"\s+", "")
    match = [(F.col("code") == t) | (F.col("name") == t) | flat.contains(t.replace(" ", "")) for t in ("0000200008", "ASIA INDIA", "AFRICA")]
    return cells(spark, d).filter(match[0] | match[1] | match[2]).select("code", "name")


@query("flt_province", with_ctes("cells", "SELECT code FROM cells WHERE starts_with(code, '00003')"))
def flt_province(spark, d):
    return cells(spark, d).filter(F.col("code").startswith("00003")).select("code")


@query("flt_search", with_ctes("facilities", "SELECT id, name FROM facilities WHERE contains(lower(name), '#00000001')"))
def flt_search(spark, d):
    return facilities(spark, d).filter(F.lower("name").contains("#00000001")).select("id", "name")


@query("flt_bbox_medical", with_ctes("facilities", "SELECT id FROM facilities WHERE lat BETWEEN 34.7 AND 35.5 AND lng BETWEEN 127.9 AND 129.0"))
def flt_bbox_medical(spark, d):
    return facilities(spark, d).filter(F.col("lat").between(34.7, 35.5) & F.col("lng").between(127.9, 129.0)).select("id")


@query("flt_pick_region", with_ctes("cells", "SELECT code, name FROM cells WHERE contains(name, 'EUROPE') ORDER BY code LIMIT 1"))
def flt_pick_region(spark, d):
    return cells(spark, d).filter(F.col("name").contains("EUROPE")).orderBy("code").limit(1).select("code", "name")


@query("sort_facility", with_ctes("facilities", "SELECT id, row_number() OVER (ORDER BY type, name, id)::INT AS place FROM facilities ORDER BY type, name, id LIMIT 50"))
def sort_facility(spark, d):
    from pyspark.sql import Window as W

    order = ["type", "name", "id"]
    return facilities(spark, d).orderBy(*order).limit(50).select("id", F.row_number().over(W.orderBy(*order)).alias("place"))


@query("win_facility_cap", with_ctes("facilities", "SELECT id, code FROM facilities ORDER BY (code = '0000200008') DESC, id % 100 DESC, id LIMIT 40"))
def win_facility_cap(spark, d):
    chosen = (F.col("code") == "0000200008").cast("int")
    return facilities(spark, d).orderBy(chosen.desc(), (F.col("id") % 100).desc(), "id").limit(40).select("id", "code")


@query("win_number_cells", with_ctes("facilities", "SELECT id, CASE WHEN count(*) OVER (PARTITION BY code) > 1 THEN row_number() OVER (PARTITION BY code ORDER BY lat DESC, lng, id) END::INT AS number FROM facilities"))
def win_number_cells(spark, d):
    return A.number_cells(facilities(spark, d)).select("id", "number")


@query("agg_list_sgg", with_ctes("cells", "SELECT sgg, min(split_part(name, ' ', 1)) AS label, count(*) AS cells FROM cells GROUP BY 1"))
def agg_list_sgg(spark, d):
    return cells(spark, d).groupBy("sgg").agg(F.min(F.split("name", " ")[0]).alias("label"), F.count(F.lit(1)).alias("cells"))


@query("agg_districts_by_sido", with_ctes("cells", "SELECT sgg, array_to_string(list_sort(list(DISTINCT name)), ',') AS names FROM cells GROUP BY 1"))
def agg_districts_by_sido(spark, d):
    return cells(spark, d).groupBy("sgg").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


@query("fn_bin_key", with_ctes("facilities", "SELECT id, floor(lng * 1000 / 100)::BIGINT || '_' || floor(lat * 1000 / 100)::BIGINT AS bin FROM facilities"))
def fn_bin_key(spark, d):
    return facilities(spark, d).select("id", geo.bin_key(F.col("lng") * 1000, F.col("lat") * 1000, 100).alias("bin"))


@query("agg_anchor", with_ctes("facilities", f"WITH b AS (SELECT id, lng * 1000 AS x, lat * 1000 AS y, floor(lng * 10)::BIGINT AS gx, floor(lat * 10)::BIGINT AS gy FROM facilities), q AS (SELECT *, {sql6('pow(x - (gx + 0.5) * 100, 2) + pow(y - (gy + 0.5) * 100, 2)', 'd')} FROM b) SELECT gx || '_' || gy AS bin, arg_min(id, (d, id)) AS id FROM q GROUP BY 1"))
def agg_anchor(spark, d):
    """Each bin's member nearest to the bin's centre."""
    rows = facilities(spark, d).select("id", (F.col("lng") * 1000).alias("x"), (F.col("lat") * 1000).alias("y"), F.concat_ws("_", F.floor(F.col("lng") * 10).cast("string"), F.floor(F.col("lat") * 10).cast("string")).alias("bin"))
    cx, cy = geo.bin_center(F.col("bin"), 100.0)
    far = half_up(F.pow(F.col("x") - cx, F.lit(2)) + F.pow(F.col("y") - cy, F.lit(2)), 6)
    return rows.groupBy("bin").agg(F.min_by("id", F.struct(far, F.col("id"))).alias("id"))


@query("agg_check_unique", with_ctes("facilities", "SELECT code, count(*) AS n FROM facilities GROUP BY 1 HAVING count(*) > 1"))
def agg_check_unique(spark, d):
    return facilities(spark, d).groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
