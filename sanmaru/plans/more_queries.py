"""Further queries: projections, filters, roles of joins, finishing steps and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sanmaru.functions import codes as K
from sanmaru.functions import shapes as P
from sanmaru.functions import text as X
from sanmaru.functions.geo import bin_center, bin_key, in_ring
from sanmaru.functions.numeric import half_up, vulnerability
from sanmaru.operators import access as A
from sanmaru.operators import boundary as B
from sanmaru.operators import crossings as E
from sanmaru.operators import cube as C
from sanmaru.operators import ingest as I
from sanmaru.operators import retrieval as R
from sanmaru.plans import ingest_queries as Q
from sanmaru.plans import tool_queries as T
from sanmaru.plans.cube_queries import NOW, REF, _last_year, _TREND_CUBE, _Z, now, r6, sql6
from sanmaru.plans.registry import query
from sanmaru.sources.bindings import cells, facilities, monthly_cube, region_series, table, with_ctes

_FLOW = Q._FLOW


@query("flt_sido_name", with_ctes("cells", "SELECT code, name FROM cells WHERE starts_with(name, 'ASIA') OR starts_with(name, 'EUROPE')"))
def flt_sido_name(spark, d):
    return I.some_rows(cells(spark, d).filter(F.col("name").startswith("ASIA") | F.col("name").startswith("EUROPE")), "no region of these provinces").select("code", "name")


@query("flt_extract_province", with_ctes("cells", "SELECT code FROM cells WHERE starts_with(code, '00001')"))
def flt_extract_province(spark, d):
    return I.some_rows(cells(spark, d).filter(F.col("code").startswith("00001")), "no region of this province").select("code")


@query("flt_region_scope", with_ctes("cells cube", f"SELECT code, {sql6('rev', 'rev')} FROM cube JOIN cells USING (code) WHERE month_no = 24018 AND (code = '0000200008' OR contains(replace(name, ' ', ''), 'EUROPE'))"))
def flt_region_scope(spark, d):
    scope = cells(spark, d).filter((F.col("code") == "0000200008") | F.regexp_replace("name", r"\s+", "").contains("EUROPE"))
    return now(spark, d).join(scope.select("code"), "code", "left_semi").select("code", r6("rev"))


@query("flt_threshold_apply", with_ctes("cube", NOW + f" SELECT code, {sql6('rev', 'rev')} FROM now WHERE rev < 900000"))
def flt_threshold_apply(spark, d):
    rows = C.threshold_if(now(spark, d), "rev", "<", 900000, unit="won", metric_unit="won", composite=False)
    return rows.select("code", r6("rev"))


@query("flt_valid_code", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 > 0")
def flt_valid_code(spark, d):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.lit("12-3")).otherwise(F.lpad(F.col("o_orderkey").cast("string"), 10, "0"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.regexp_replace(raw, "[^0-9]", "").alias("code"))
    return I.valid_codes(rows).select("id")


@query("flt_bbox_hira", with_ctes("facilities", "SELECT id FROM facilities WHERE lat BETWEEN 34.2 AND 36.2 AND lng BETWEEN 127.3 AND 129.8"))
def flt_bbox_hira(spark, d):
    return facilities(spark, d).filter(F.col("lat").between(34.2, 36.2) & F.col("lng").between(127.3, 129.8)).select("id")


@query("flt_facility_region", with_ctes("facilities cells", "SELECT id FROM facilities JOIN cells c USING (code) WHERE c.code = '0000300006' OR contains(replace(c.name, ' ', ''), 'AMERICA')"))
def flt_facility_region(spark, d):
    c = cells(spark, d).filter((F.col("code") == "0000300006") | F.regexp_replace("name", " ", "").contains("AMERICA"))
    return facilities(spark, d).join(c.select("code"), "code", "left_semi").select("id")


@query("flt_place_district", with_ctes("cells", "SELECT code FROM cells WHERE sgg = '00002' OR contains(name, 'RUSSIA')"))
def flt_place_district(spark, d):
    return cells(spark, d).filter((F.col("sgg") == "00002") | F.col("name").contains("RUSSIA")).select("code")


@query("flt_place_code", with_ctes("cells", "SELECT code, name FROM cells WHERE code = '0000000000'"))
def flt_place_code(spark, d):
    return cells(spark, d).filter("code = '0000000000'").select("code", "name")


@query("prj_resident", with_ctes("series", "SELECT code, month, population, households FROM series"))
def prj_resident(spark, d):
    return region_series(spark, d).select("code", "month", "population", "households")


@query("prj_age_long", "SELECT c_custkey AS id, c_custkey % 100 AS age, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END::INT AS male, CASE WHEN c_custkey % 2 = 1 THEN 1 ELSE 0 END::INT AS female FROM customer")
def prj_age_long(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), (k % 100).alias("age"), (k % 2 == 0).cast("int").alias("male"), (k % 2 == 1).cast("int").alias("female"))


@query("prj_common", "SELECT s_suppkey AS id, lpad(s_suppkey::VARCHAR, 10, '0') AS code, '2001-07' AS month FROM supplier")
def prj_common(spark, d):
    from sanmaru.functions.codes import clean_code, first_known, normal_month

    raw = F.lpad(F.col("s_suppkey").cast("string"), 10, "0")
    code = first_known(F.when(F.col("s_suppkey") % 2 == 0, raw), F.concat(F.lit("c"), raw))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), clean_code(code).alias("code"), normal_month(F.lit("200107")).alias("month"))


@query("prj_facility_map", with_ctes("facilities", "SELECT id, CASE WHEN type IN ('hospital', 'clinic', 'pharmacy') THEN type ELSE 'other' END AS kind FROM facilities WHERE id % 5 > 0"))
def prj_facility_map(spark, d):
    """Rows without coordinates are dropped; labels go to kinds by ordered rules."""
    rows = facilities(spark, d).withColumn("lat", F.when(F.col("id") % 5 > 0, F.col("lat")))
    kind = F.when(F.col("type").contains("hospital"), "hospital").when(F.col("type").contains("clinic"), "clinic").when(F.col("type").contains("pharm"), "pharmacy").otherwise("other")
    return rows.filter("lat is not null").select("id", kind.alias("kind"))


@query("prj_access", with_ctes("cells facilities series", f"WITH {T.ACCESS} SELECT code, {sql6('nearest_km', 'nearest_km')}, within, own, {sql6('within / population * 10000', 'per_10k')} FROM acc JOIN series USING (code) WHERE month_no = 24018"))
def prj_access(spark, d):
    rows = A.access(cells(spark, d), facilities(spark, d), 2).join(region_series(spark, d).filter(F.col("month_no") == REF), "code")
    return rows.select("code", r6("nearest_km"), "within", "own", r6(F.col("within") / F.col("population") * 10000, "per_10k"))


@query("prj_at_month", with_ctes("cube", f"SELECT code, {sql6('rev', 'value')} FROM cube WHERE month_no = 24003"))
def prj_at_month(spark, d):
    return C.at_month(monthly_cube(spark, d), 24003).select("code", r6("rev", "value"))


@query("prj_ref_value", with_ctes("series", "SELECT code, population AS value FROM series WHERE month_no = 24018"))
def prj_ref_value(spark, d):
    return region_series(spark, d).filter(F.col("month_no") == REF).select("code", F.col("population").alias("value"))


@query("prj_layer_value", with_ctes("cells cube", f"SELECT code, {sql6('qty', 'value')} FROM cells LEFT JOIN (SELECT * FROM cube WHERE month_no = 24001) USING (code)"))
def prj_layer_value(spark, d):
    return cells(spark, d).join(C.at_month(monthly_cube(spark, d), 24001), "code", "left").select("code", r6("qty", "value"))


@query("join_commute_two_roles", f"WITH {_FLOW}, j AS (SELECT work AS code, sum(n)::BIGINT AS jobs FROM fl WHERE quarter = '20001' GROUP BY 1), h AS (SELECT home AS code, sum(n)::BIGINT AS workers FROM fl WHERE quarter = '20001' GROUP BY 1), c AS (SELECT lpad(n_nationkey::VARCHAR, 10, '0') AS code FROM nation) SELECT code, jobs, workers FROM c LEFT JOIN j USING (code) LEFT JOIN h USING (code)")
def join_commute_two_roles(spark, d):
    rows = Q.flow_rows(spark, d).filter("quarter = '20001'")
    base = table(spark, d, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 10, "0").alias("code"))
    jobs, homes = rows.groupBy(F.col("work").alias("code")).agg(F.sum("n").alias("jobs")), rows.groupBy(F.col("home").alias("code")).agg(F.sum("n").alias("workers"))
    return base.join(jobs, "code", "left").join(homes, "code", "left")


@query("join_grid_semi", "SELECT count(*) FILTER (o_custkey % 40 < 25) AS kept, count(*) FILTER (o_custkey % 40 >= 25) AS dropped FROM orders")
def join_grid_semi(spark, d):
    """Rows whose grid key is known; how many are dropped is reported."""
    known = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("gid"), F.lit(True).alias("known"))
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("gid")).join(known, "gid", "left")
    return rows.agg(F.count_if(F.col("known")).alias("kept"), F.count_if(F.col("known").isNull()).alias("dropped"))


@query("agg_births_deaths", with_ctes("series", "SELECT code, sum(births)::BIGINT AS births, sum(deaths)::BIGINT AS deaths FROM series GROUP BY 1"))
def agg_births_deaths(spark, d):
    return region_series(spark, d).groupBy("code").agg(F.sum("births").alias("births"), F.sum("deaths").alias("deaths"))


@query("agg_pop_live", with_ctes("series", "SELECT substr(code, 1, 5) AS code, month, sum(population)::BIGINT AS population, sum(households)::BIGINT AS households FROM series GROUP BY 1, 2"))
def agg_pop_live(spark, d):
    return region_series(spark, d).groupBy(F.substring("code", 1, 5).alias("code"), "month").agg(F.sum("population").alias("population"), F.sum("households").alias("households"))


@query("agg_vitals_live", with_ctes("series", "SELECT substr(code, 1, 5) AS code, month, sum(births)::BIGINT AS births FROM series GROUP BY 1, 2"))
def agg_vitals_live(spark, d):
    return region_series(spark, d).groupBy(F.substring("code", 1, 5).alias("code"), "month").agg(F.sum("births").alias("births"))


@query("agg_oneperson_sum", with_ctes("series", "SELECT month, sum(one_person)::BIGINT AS one_person FROM series GROUP BY 1"))
def agg_oneperson_sum(spark, d):
    return region_series(spark, d).groupBy("month").agg(F.sum("one_person").alias("one_person"))


@query("agg_sum_field", "SELECT o_orderstatus AS status, coalesce(sum(CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END), 0)::DOUBLE AS total FROM orders GROUP BY 1")
def agg_sum_field(spark, d):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.lit("n/a")).otherwise(F.col("o_orderkey").cast("string"))
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.coalesce(F.sum(raw.try_cast("double")), F.lit(0.0)).alias("total"))


@query("agg_list_districts", with_ctes("cells", "SELECT DISTINCT split_part(name, ' ', 1) AS label FROM cells"))
def agg_list_districts(spark, d):
    return cells(spark, d).select(F.split("name", " ")[0].alias("label")).distinct()


@query("agg_inflow", f"WITH {_FLOW}, {Q._MOVE} SELECT quarter, code, sum(n)::BIGINT AS move_in FROM mv WHERE previous <> current GROUP BY 1, 2")
def agg_inflow(spark, d):
    return I.external_moves(Q._moves(spark, d)).groupBy("quarter", "code").agg(F.sum("n").alias("move_in"))


@query("agg_outflow", f"WITH {_FLOW}, {Q._MOVE} SELECT quarter, previous AS sgg, sum(n)::BIGINT AS move_out FROM mv WHERE previous <> current GROUP BY 1, 2")
def agg_outflow(spark, d):
    return I.external_moves(Q._moves(spark, d)).groupBy("quarter", F.col("previous").alias("sgg")).agg(F.sum("n").alias("move_out"))


@query("agg_distinct_medical", with_ctes("facilities", "SELECT type, code, min(id) AS id FROM facilities GROUP BY 1, 2"))
def agg_distinct_medical(spark, d):
    return I.dedup_first(facilities(spark, d).select("type", "code", "id"), ["type", "code"], "id")


@query("win_rank", with_ctes("series", "SELECT code, one_person AS score, row_number() OVER (ORDER BY one_person DESC, code)::INT AS rank FROM series WHERE month_no = 24018 AND one_person IS NOT NULL"))
def win_rank(spark, d):
    rows = region_series(spark, d).filter(F.col("month_no") == REF).select("code", F.col("one_person").alias("score"))
    return C.rank_rows(rows, "score", keep_null=False)


@query("win_zscore_trend", with_ctes("cube", _TREND_CUBE.format(m="rev") + f" SELECT code, {sql6(_Z.format(v='change'), 'z')} FROM c WHERE change IS NOT NULL"))
def win_zscore_trend(spark, d):
    return C.z_scores(C.trends(_last_year(spark, d), "rev", 12).filter("change is not null"), ("change", "z")).select("code", r6("z"))


@query("win_trend_rank", with_ctes("cube", _TREND_CUBE.format(m="qty") + f" SELECT code, {sql6('change', 'change')}, row_number() OVER (ORDER BY change ASC, code)::INT AS rank FROM c WHERE change IS NOT NULL"))
def win_trend_rank(spark, d):
    return C.trend_ranking(_last_year(spark, d), "qty", 12, descending=False).select("code", r6("change"), "rank")


@query("topk_explicit", with_ctes("cube", NOW + " SELECT code, row_number() OVER (ORDER BY qty DESC, code)::INT AS rank FROM now ORDER BY qty DESC, code LIMIT 7"))
def topk_explicit(spark, d):
    return C.rank_rows(now(spark, d), "qty", limit=7).select("code", "rank")


@query("topk_export", with_ctes("cube", NOW + " SELECT code, row_number() OVER (ORDER BY qty DESC, code)::INT AS rank FROM now"))
def topk_export(spark, d):
    """An export keeps the order and drops the page."""
    return C.rank_rows(now(spark, d), "qty").select("code", "rank")


@query("sort_compare", with_ctes("series facilities", T._DISTRICT.replace("IN ('00000', '00002', '00004')", "IN ('00001', '00003')")))
def sort_compare(spark, d):
    from sanmaru.operators.tools import compare_districts

    return compare_districts(region_series(spark, d), facilities(spark, d), ["00001", "00003"], REF)


@query("set_union_quarters", f"WITH {_FLOW} SELECT DISTINCT quarter FROM fl WHERE starts_with(quarter, '2000') OR starts_with(quarter, '1999')")
def set_union_quarters(spark, d):
    rows = Q.flow_rows(spark, d).select("quarter")
    return rows.filter(F.col("quarter").startswith("2000")).union(rows.filter(F.col("quarter").startswith("1999"))).distinct()


@query("fn_vuln_index", "SELECT o_orderkey AS id, CASE WHEN o_custkey % 4 > 0 THEN " + "floor((0.35 * (o_orderkey % 101) + 0.25 * (o_custkey % 101) + 0.25 * 50 + 0.15 * 10) * 1e6 + 0.5) / 1e6 END AS v FROM orders")
def fn_vuln_index(spark, d):
    a, b = (F.col("o_orderkey") % 101).cast("double"), F.when(F.col("o_custkey") % 4 > 0, (F.col("o_custkey") % 101).cast("double"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), r6(vulnerability(a, b, F.lit(50.0), F.lit(10.0)), "v"))


@query("fn_round_adapter", "SELECT o_orderkey AS id, floor(o_totalprice / 8 * 10 + 0.5) / 10 AS v FROM orders")
def fn_round_adapter(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), half_up(F.col("o_totalprice") / 8, 1).alias("v"))


@query("fn_bin_center", with_ctes("facilities", "SELECT id, (floor(lng * 10) + 0.5) * 100.0::DOUBLE AS x, (floor(lat * 10) + 0.5) * 100.0::DOUBLE AS y FROM facilities"))
def fn_bin_center(spark, d):
    rows = facilities(spark, d).select("id", bin_key(F.col("lng") * 1000, F.col("lat") * 1000, 100).alias("bin"))
    x, y = bin_center(F.col("bin"), 100.0)
    return rows.select("id", x.alias("x"), y.alias("y"))


_TRIANGLE = [[127.6, 34.6], [129.0, 34.6], [128.0, 35.8], [127.6, 34.6]]


def _ring():
    return F.array(*[F.array(*map(F.lit, map(float, p))) for p in _TRIANGLE])


_INSIDE = "lat >= 34.6 AND ((128.0 - 129.0) * (lat - 34.6) - (35.8 - 34.6) * (lng - 129.0)) >= 0 AND ((127.6 - 128.0) * (lat - 35.8) - (34.6 - 35.8) * (lng - 128.0)) >= 0"


@query("fn_point_in_ring", with_ctes("facilities", f"SELECT id, {_INSIDE} AS inside FROM facilities"))
def fn_point_in_ring(spark, d):
    return facilities(spark, d).select("id", in_ring(F.col("lng"), F.col("lat"), _ring()).alias("inside"))


def _quads(spark, d):
    """Four-cornered rings around facilities; every third one is tied like a bow."""
    x, y = F.col("lng"), F.col("lat")
    a, b, c, e = F.array(x, y), F.array(x + 0.1, y), F.array(x + 0.1, y + 0.1), F.array(x, y + 0.1)
    return facilities(spark, d).select("id", F.when(F.col("id") % 3 == 0, F.array(a, c, b, e, a)).otherwise(F.array(a, b, c, e, a)).alias("ring"))


@query("fn_self_intersect", with_ctes("facilities", "SELECT id, id % 3 = 0 AS crossing FROM facilities"))
def fn_self_intersect(spark, d):
    rings = _quads(spark, d)
    crossed = E.crossing_rings(E.ring_edges(rings, ["id"]), ["id"]).withColumn("hit", F.lit(True))
    return rings.select("id").join(crossed, "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("crossing"))


@query("fn_ring_checks", with_ctes("facilities", "SELECT id, CASE WHEN id % 4 = 1 THEN 'short' WHEN id % 4 = 2 THEN 'open' WHEN id % 3 = 0 THEN 'crossing' END AS problem FROM facilities"))
def fn_ring_checks(spark, d):
    ring = F.when(F.col("id") % 4 == 1, F.slice("ring", 1, 3)).when(F.col("id") % 4 == 2, F.slice("ring", 1, 4)).otherwise(F.col("ring"))
    return E.ring_problems(_quads(spark, d).select("id", ring.alias("ring")))


def _squares(spark, d):
    """Square rings at all facilities."""
    x, y = F.col("lng"), F.col("lat")
    a, b, c, e = F.array(x, y), F.array(x + 0.1, y), F.array(x + 0.1, y + 0.1), F.array(x, y + 0.1)
    return facilities(spark, d).select("id", "lat", "lng", F.array(a, b, c, e, a).alias("ring"))


@query("fn_rings_intersect", with_ctes("facilities", "SELECT a.id, count(*) AS others FROM facilities a JOIN facilities b ON a.id <> b.id AND b.lat <= a.lat + 0.1 AND a.lat <= b.lat + 0.1 AND b.lng <= a.lng + 0.1 AND a.lng <= b.lng + 0.1 GROUP BY a.id"))
def fn_rings_intersect(spark, d):
    """How many other rings each ring meets."""
    return E.meeting_counts(_squares(spark, d).select("id", "ring"))


@query("fn_holes_inside", with_ctes("facilities", "SELECT id, id % 2 = 0 AS inside FROM facilities"))
def fn_holes_inside(spark, d):
    x0, y0 = F.col("ring")[0][0], F.col("ring")[0][1]
    small = F.transform("ring", lambda p: F.array(x0 + 0.02 + (p[0] - x0) * 0.5, y0 + 0.02 + (p[1] - y0) * 0.5))
    away = F.transform("ring", lambda p: F.array(p[0] + 0.05, p[1] + 0.05))
    return _squares(spark, d).select("id", P.holes_inside(F.array("ring", F.when(F.col("id") % 2 == 0, small).otherwise(away))).alias("inside"))


@query("fn_coord_swap", with_ctes("facilities", "SELECT id, lat, lng FROM facilities"))
def fn_coord_swap(spark, d):
    return _squares(spark, d).select("id", P.swap_points(F.col("ring"))[0].alias("p")).select("id", "p.lat", "p.lng")


_NAMED = "CASE ordinal % 4 WHEN 0 THEN '경상남도 창원시 의창구 ' || name WHEN 1 THEN '경상남도  진주시 ' || name WHEN 2 THEN '하동군 ' || name ELSE '경상남도 김해시' END"


@query("fn_sgg_name", with_ctes("cells", "SELECT code, CASE ordinal % 4 WHEN 0 THEN '창원시 의창구' WHEN 1 THEN '진주시' WHEN 2 THEN '하동군' ELSE '김해시' END AS v FROM cells"))
def fn_sgg_name(spark, d):
    """City and ward, else the first word."""
    return cells(spark, d).select("code", K.district_name(F.expr(_NAMED), "경상남도").alias("v"))


@query("fn_district", with_ctes("cells", "SELECT code, nullif(regexp_extract(name, '([A-Z]+CA)\\b', 1), '') AS v FROM cells"))
def fn_district(spark, d):
    """The token with the suffix, or null."""
    return cells(spark, d).select("code", F.nullif(F.regexp_extract("name", r"([A-Z]+CA)\b", 1), F.lit("")).alias("v"))


@query("fn_district_label", with_ctes("cells", "SELECT code, coalesce(nullif(regexp_extract(name, '([A-Z]+CA)\\b', 1), ''), split_part(name, ' ', 2)) AS v FROM cells"))
def fn_district_label(spark, d):
    return cells(spark, d).select("code", F.coalesce(F.nullif(F.regexp_extract("name", r"([A-Z]+CA)\b", 1), F.lit("")), F.get(F.split("name", " "), F.lit(1))).alias("v"))


_LABELS = ("상급종합병원", "종합병원", "요양병원", "한방병원", "의원", "치과의원", "한의원", "보건지소", "동네약국", "정신병원", "의원급", "", "조산원")
_REGISTER = "CASE x WHEN 0 THEN '종합병원' WHEN 1 THEN '종합병원' WHEN 2 THEN '요양병원' WHEN 3 THEN '병원' WHEN 4 THEN '의원' WHEN 5 THEN '치과의원' WHEN 6 THEN '한의원' WHEN 7 THEN '보건소' WHEN 8 THEN '약국' WHEN 9 THEN '병원' WHEN 10 THEN '의원' ELSE CASE p_size WHEN 1 THEN '종합병원' WHEN 11 THEN '종합병원' WHEN 21 THEN '병원' WHEN 41 THEN '병원' WHEN 28 THEN '요양병원' WHEN 31 THEN '의원' END END"


@query("fn_clinic_type", f"SELECT p_partkey AS id, {_REGISTER} AS v FROM (SELECT *, p_partkey % 13 AS x FROM part)")
def fn_clinic_type(spark, d):
    """Labels of the register decide first, two-digit codes after."""
    label = F.get(F.array(*map(F.lit, _LABELS)), (F.col("p_partkey") % 13).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), B.type_of_register(label, F.lpad(F.col("p_size").cast("string"), 2, "0")).alias("v"))


@query("fn_age_group", "SELECT c_custkey AS id, CASE WHEN c_custkey % 100 < 35 THEN 'youth' WHEN c_custkey % 100 < 65 THEN 'middle' ELSE 'senior' END AS v FROM customer")
def fn_age_group(spark, d):
    a = F.col("c_custkey") % 100
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(a < 35, "youth").when(a < 65, "middle").otherwise("senior").alias("v"))


def _mapped(column, pairs):
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[column]


@query("fn_industry_group", "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'food' WHEN 'N' THEN 'retail' WHEN 'R' THEN 'health' END AS v FROM lineitem")
def fn_industry_group(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _mapped(F.col("l_returnflag"), {"A": "food", "N": "retail", "R": "health"}).alias("v"))


@query("fn_store_group", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber IN (1, 3) THEN 'restaurant' WHEN l_linenumber = 2 THEN 'cafe' END AS v FROM lineitem")
def fn_store_group(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _mapped(F.col("l_linenumber"), {1: "restaurant", 3: "restaurant", 2: "cafe"}).alias("v"))


@query("fn_hours_build", with_ctes("facilities", "SELECT id, CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END::INT AS days FROM facilities"))
def fn_hours_build(spark, d):
    """Days without hours are left out."""
    days = F.map_filter(F.map_from_arrays(F.array(F.lit("monday"), F.lit("saturday")), F.array(F.lit("09:00-18:00"), F.when(F.col("id") % 3 == 0, F.lit("09:00-13:00")))), lambda k, v: v.isNotNull())
    return facilities(spark, d).select("id", F.size(days).alias("days"))


@query("fn_hours_map", "SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'friday=-, monday=09:00-' || lpad((event_id % 24)::VARCHAR, 2, '0') || ':00' WHEN 1 THEN 'sunday=' || event_type END AS v FROM events")
def fn_hours_map(spark, d):
    """Hours by day as text; numbers, lists and what is no object are passed over."""
    k = F.col("event_id")
    late = F.concat(F.lit('{"monday": "09:00-'), F.lpad((k % 24).cast("string"), 2, "0"), F.lit(':00", "friday": null, "n": 4, "list": ["x"]}'))
    raw = F.when(k % 4 == 0, late).when(k % 4 == 1, F.concat(F.lit('{"sunday": "'), F.col("event_type"), F.lit('", "o": {"a": "b"}}'))).when(k % 4 == 2, F.col("props")).otherwise(F.lit("[1, 2]"))
    pairs = F.transform(F.array_sort(F.map_entries(K.hours_map(raw))), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("-"))))
    return table(spark, d, "events").select(k.alias("id"), F.array_join(pairs, ", ").alias("v"))


@query("fn_tf", "SELECT doc_id AS id, len(list_filter(w, lambda x: x = 'is'))::INT AS tf, len(w)::INT AS words FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents)")
def fn_tf(spark, d):
    """How often a word occurs among all words of a text."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), 0)
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.term_frequency(words, "is").alias("tf"), F.size(words).alias("words"))


@query("fn_radians", with_ctes("facilities", f"SELECT id, {sql6('radians((lng * 10) % 360)', 'v')} FROM facilities"))
def fn_radians(spark, d):
    return facilities(spark, d).select("id", r6(F.radians((F.col("lng") * 10) % 360), "v"))


@query("fn_ref_month", "SELECT o_orderkey AS id, strftime(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH, '%Y-%m') AS v FROM orders")
def fn_ref_month(spark, d):
    version = F.date_format("o_orderdate", "yyyyMMdd")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.date_format(F.add_months(F.trunc(F.to_date(version, "yyyyMMdd"), "month"), -1), "yyyy-MM").alias("v"))


@query("fn_tier", with_ctes("series", "SELECT code, month, CASE WHEN population < 5 THEN 1 WHEN population < 8 THEN 2 WHEN population < 11 THEN 3 ELSE 4 END::INT AS v FROM series"))
def fn_tier(spark, d):
    p = F.col("population")
    return region_series(spark, d).select("code", "month", F.when(p < 5, 1).when(p < 8, 2).when(p < 11, 3).otherwise(4).alias("v"))


@query("fn_rank_word", with_ctes("cube", "WITH c AS (SELECT *, row_number() OVER (PARTITION BY month_no ORDER BY CASE WHEN month_no % 2 = 0 THEN rev ELSE -rev END, code) AS rank FROM cube) SELECT month_no, CASE WHEN count(*) >= 3 AND min_by(rev, rank) < max_by(rev, rank) THEN 'ascending' ELSE 'descending' END AS v FROM c GROUP BY 1"))
def fn_rank_word(spark, d):
    """Which way the rows of each month's ranking go: by the first and the last of them."""
    order = F.when(F.col("month_no") % 2 == 0, F.col("rev")).otherwise(-F.col("rev"))
    ranked = monthly_cube(spark, d).withColumn("rank", F.row_number().over(W.partitionBy("month_no").orderBy(order, "code")))
    return ranked.groupBy("month_no").agg(C.rank_word("rev", "rank").alias("v"))


@query("fn_remote_cos", f"SELECT q.vec_id AS query_id, v.vec_id AS id, {sql6('list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])))', 'score')} FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id % 50 = 0")
def fn_remote_cos(spark, d):
    """Each query with the vectors of its label."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    return R.vector_scores(v.filter("id % 50 = 0"), v, within="label").select("query_id", "id", r6("score"))


@query("fn_staleness", "SELECT event_id AS id, floor((epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(ts)) / 3600)::BIGINT AS hours, floor((epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(ts)) / 3600) > 48 AS stale FROM events")
def fn_staleness(spark, d):
    hours = F.expr("timestampdiff(HOUR, ts, timestamp'2024-02-01 00:00:00')")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), hours.alias("hours"), (hours > 48).alias("stale"))
