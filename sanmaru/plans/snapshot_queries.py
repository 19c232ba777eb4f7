"""Queries of the assembled snapshot and of intents run as one plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from sanmaru.operators import dispatch as D
from sanmaru.operators import snapshot as N
from sanmaru.plans.cube_queries import REF, r6, sql6
from sanmaru.plans.registry import query
from sanmaru.sources.bindings import _customer_codes, _month_no, cells, facilities, region_series, table, with_ctes

# Five feeds of orders: months 24000 to 24018, one row for each order. Births lack a region in a month, deaths have blank values, ages miss a month before the last 13.
_FEED = """o AS (SELECT lpad(n_regionkey::VARCHAR, 5, '0') || lpad(n_nationkey::VARCHAR, 5, '0') AS code, (year(o_orderdate) * 12 + month(o_orderdate) - 1)::INT AS month_no, o_orderkey, o_custkey, o_orderpriority, o_orderstatus
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE year(o_orderdate) * 12 + month(o_orderdate) - 1 BETWEEN 24000 AND 24018),
re AS (SELECT code, month_no, sum(1 + o_custkey % 3)::BIGINT AS population, count(*) AS households, 0 AS bad FROM o GROUP BY ALL),
ag AS (SELECT code, month_no, count(*) FILTER (o_orderpriority = '5-LOW') AS youth, count(*) FILTER (o_orderpriority NOT IN ('5-LOW', '1-URGENT')) AS working, count(*) FILTER (o_orderpriority = '1-URGENT') AS elderly, 0 AS bad FROM o WHERE month_no <> 24002 GROUP BY ALL),
op AS (SELECT code, month_no, count(*) AS one_person FROM o WHERE o_orderstatus = 'P' GROUP BY ALL),
bi AS (SELECT code, month_no, count(*) FILTER (o_orderstatus = 'O') AS births, 0 AS bad FROM o WHERE NOT (code = '0000200008' AND month_no = 24010) GROUP BY ALL),
de AS (SELECT code, month_no, count(*) FILTER (o_orderstatus = 'F') AS deaths, count(*) FILTER (o_orderkey % 389 = 0) AS bad FROM o GROUP BY ALL),
mo AS (SELECT month_no FROM re INTERSECT SELECT month_no FROM ag INTERSECT SELECT month_no FROM bi INTERSECT SELECT month_no FROM de ORDER BY month_no DESC LIMIT 13),
g AS (SELECT c.code, c.area_km2, mo.month_no, re.bad AS r_, ag.bad AS a_, bi.bad AS b_, de.bad AS d_, population, households, youth, working, elderly, one_person, births, deaths
  FROM cells c CROSS JOIN mo LEFT JOIN re USING (code, month_no) LEFT JOIN ag USING (code, month_no) LEFT JOIN op USING (code, month_no) LEFT JOIN bi USING (code, month_no) LEFT JOIN de USING (code, month_no)),
l AS (SELECT 'missing' AS fault, unnest(list_filter([CASE WHEN r_ IS NULL THEN 'resident' END, CASE WHEN a_ IS NULL THEN 'ages' END, CASE WHEN b_ IS NULL THEN 'births' END, CASE WHEN d_ IS NULL THEN 'deaths' END], lambda x: x IS NOT NULL)) AS feed, code, month_no FROM g
  UNION ALL SELECT 'blank', 'deaths', code, month_no FROM g WHERE d_ > 0)"""


def _feeds(spark, d):
    o = table(spark, d, "orders").withColumn("month_no", _month_no("o_orderdate")).filter(F.col("month_no").between(24000, 24018))
    o = o.join(_customer_codes(spark, d), F.col("o_custkey") == F.col("c_custkey"))
    one = lambda c: F.when(c, F.lit(1)).otherwise(0)
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    return {
        "resident": o.select("code", "month_no", (1 + F.col("o_custkey") % 3).alias("population"), F.lit(1).alias("households")),
        "ages": o.filter("month_no <> 24002").select("code", "month_no", one(p == "5-LOW").alias("youth"), one(~p.isin("5-LOW", "1-URGENT")).alias("working"), one(p == "1-URGENT").alias("elderly")),
        "one_person": o.filter(s == "P").select("code", "month_no", F.lit(1).alias("one_person")),
        "births": o.filter("not (code = '0000200008' and month_no = 24010)").select("code", "month_no", one(s == "O").alias("births")),
        "deaths": o.select("code", "month_no", F.when(F.col("o_orderkey") % 389 > 0, one(s == "F")).alias("deaths")),
    }


@query("job_normalize", with_ctes("cells", f"WITH {_FEED} SELECT code, month_no, population, households, {sql6('population / area_km2', 'density')}, youth, working, elderly, one_person, births, deaths, births - deaths AS natural_change FROM g WHERE code NOT IN (SELECT code FROM l)"))
def job_normalize(spark, d):
    rows, _ = N.normalize(cells(spark, d), _feeds(spark, d))
    return rows.withColumn("density", r6("density"))


@query("job_normalize_ledger", with_ctes("cells", f"WITH {_FEED} SELECT fault, feed, code, month_no FROM l"))
def job_normalize_ledger(spark, d):
    return N.normalize(cells(spark, d), _feeds(spark, d))[1]


# An intent for each supplier, some of them at fault.
_TOOLS = ("rankPopulationSize", "rankDeathCount", "rankElderlyRatio", "rankPopulationDensity", "countFacilitiesWithinRadius", "nearestFacilityDistance", "rankNaturalIncrease", "rankWeather")
_INTENTS = """i AS (SELECT s_suppkey AS id, ['rankPopulationSize','rankDeathCount','rankElderlyRatio','rankPopulationDensity','countFacilitiesWithinRadius','nearestFacilityDistance','rankNaturalIncrease','rankWeather'][s_suppkey % 8 + 1] AS tool,
  CASE s_suppkey % 3 WHEN 0 THEN 'sgg' WHEN 1 THEN 'dong' END AS level, CASE WHEN s_suppkey % 8 = 4 OR s_suppkey % 10 = 0 THEN 0.5::DOUBLE + s_suppkey % 7 * 0.5::DOUBLE END AS km,
  CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey % 5 * 200 - 199 END AS lim, CASE s_suppkey % 11 WHEN 0 THEN 'ascending' WHEN 1 THEN 'up' END AS direction, CASE WHEN s_suppkey % 13 = 0 THEN ['ASI', '0000200008'] END AS regions FROM supplier),
x AS (
  SELECT id, 'unknown tool' AS fault FROM i WHERE tool = 'rankWeather' UNION ALL SELECT id, 'radius' FROM i WHERE km < 1 OR km > 3 UNION ALL SELECT id, 'limit' FROM i WHERE lim > 600 UNION ALL SELECT id, 'direction' FROM i WHERE direction = 'up')"""


def _intents(spark, d):
    k = F.col("s_suppkey")
    radius = F.when((k % 8 == 4) | (k % 10 == 0), 0.5 + k % 7 * 0.5)
    return table(spark, d, "supplier").select(
        k.alias("id"), F.get(F.array(*map(F.lit, _TOOLS)), (k % 8).cast("int")).alias("tool"), F.when(k % 3 == 0, "sgg").when(k % 3 == 1, "dong").alias("level"), radius.alias("radius_km"),
        F.when(k % 5 > 0, k % 5 * 200 - 199).alias("limit"), F.when(k % 11 == 0, "ascending").when(k % 11 == 1, "up").alias("direction"), F.when(k % 13 == 0, F.array(F.lit("ASI"), F.lit("0000200008"))).alias("regions"),
    )


_KM = "2 * 6371.0088 * atan2(sqrt(h), sqrt(1 - h))"
_LEVELS = f"""now AS (SELECT * FROM series WHERE month_no = 24018),
sd AS (SELECT code, 'dong' AS level, name, lat, lng, area_km2, population::DOUBLE AS population, deaths, births, elderly FROM cells LEFT JOIN now USING (code)),
ss AS (SELECT substr(code, 1, 5) AS code, 'sgg' AS level, min(split_part(name, ' ', 1)) AS name, sum(lat * population) FILTER (population IS NOT NULL) / sum(population) AS lat, sum(lng * population) FILTER (population IS NOT NULL) / sum(population) AS lng,
  sum(area_km2) AS area_km2, sum(area_km2) FILTER (population IS NOT NULL) AS own_area, sum(population) AS population, sum(deaths) AS deaths, sum(births) AS births, sum(elderly) AS elderly FROM sd GROUP BY 1 HAVING count(population) > 0),
s AS (SELECT code, level, replace(name, ' ', '') AS name, lat, lng, area_km2, population, deaths, births, elderly FROM sd UNION ALL SELECT code, level, name, lat, lng, area_km2, population, deaths, births, elderly FROM ss),
p AS (SELECT s.code, s.level, pow(sin((radians(f.lat) - radians(s.lat)) / 2), 2) + cos(radians(s.lat)) * cos(radians(f.lat)) * pow(sin(radians(f.lng - s.lng) / 2), 2) AS h FROM s CROSS JOIN facilities f),
km AS (SELECT code, level, {_KM} AS km FROM p),
ra AS (SELECT DISTINCT coalesce(km, 2) AS radius FROM i WHERE tool = 'countFacilitiesWithinRadius' AND id NOT IN (SELECT id FROM x)),
sc AS (
  SELECT 'rankPopulationSize' AS tool, NULL::DOUBLE AS radius, level, code, name, population::DOUBLE AS score FROM s UNION ALL SELECT 'rankDeathCount', NULL, level, code, name, deaths FROM s
  UNION ALL SELECT 'rankElderlyRatio', NULL, level, code, name, floor(elderly / population * 100 * 100 + 0.5) / 100 FROM s UNION ALL SELECT 'rankPopulationDensity', NULL, level, code, name, floor(population / area_km2 * 100 + 0.5) / 100 FROM s
  UNION ALL SELECT 'rankNaturalIncrease', NULL, level, code, name, births - deaths FROM s
  UNION ALL SELECT 'nearestFacilityDistance', NULL, level, code, any_value(name), floor(min(km) * 100 + 0.5) / 100 FROM s JOIN km USING (code, level) GROUP BY level, code
  UNION ALL SELECT 'countFacilitiesWithinRadius', radius, level, code, any_value(name), count(*) FILTER (km <= radius) FROM s JOIN km USING (code, level), ra GROUP BY level, code, radius)"""


@query("executeAnalysisIntent", with_ctes("cells facilities series", f"""WITH {_INTENTS}, {_LEVELS}
SELECT id, i.tool AS tool, CASE coalesce(i.level, 'dong') WHEN 'sgg' THEN '시군구' ELSE '행정동' END AS level,
  row_number() OVER (PARTITION BY id ORDER BY CASE WHEN coalesce(direction = 'descending', i.tool <> 'countFacilitiesWithinRadius') THEN -score ELSE score END, code)::INT AS rank, code, {sql6('score', 'score')}
FROM i JOIN sc ON sc.tool = i.tool AND sc.level = coalesce(i.level, 'dong') AND radius IS NOT DISTINCT FROM CASE WHEN i.tool = 'countFacilitiesWithinRadius' THEN coalesce(km, 2) END
WHERE score IS NOT NULL AND id NOT IN (SELECT id FROM x) AND (regions IS NULL OR contains(name, 'ASI') OR code = '0000200008') QUALIFY rank <= coalesce(lim, 10)"""))
def execute_analysis(spark, d):
    rows, _ = D.run_intents(_intents(spark, d), region_series(spark, d), cells(spark, d), facilities(spark, d), REF)
    return rows.withColumn("score", r6("score"))


@query("executeAnalysisIntent_faults", f"WITH {_INTENTS} SELECT id, fault FROM x")
def execute_analysis_faults(spark, d):
    return D.intent_faults(_intents(spark, d), cells(spark, d))
