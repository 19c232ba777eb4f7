"""Queries of the feeds, with lines made from the driver's tables and parsed again."""

from __future__ import annotations

from pyspark.sql import functions as F

from sanmaru.functions.codes import clean_code, field_number
from sanmaru.functions.numeric import half_up
from sanmaru.operators import ingest as I
from sanmaru.plans.cube_queries import r6, sql6
from sanmaru.plans.registry import query
from sanmaru.sources.bindings import cells, facilities, region_series, table, with_ctes
from sanmaru.sources.sinks import checksum

_CARD = "card AS (SELECT lpad((l_suppkey % 25)::VARCHAR, 10, '0') AS code, strftime(l_shipdate, '%Y-%m') AS month, l_returnflag AS sector, l_linestatus AS status, l_linenumber AS line, l_extendedprice AS amount, l_quantity AS txns FROM lineitem)"


def card_lines(spark, d):
    """Comma-separated lines of card sales: code, date, sector, status, line, count, amount."""
    t = table(spark, d, "lineitem")
    code = F.lpad((F.col("l_suppkey") % 25).cast("string"), 10, "0")
    return t.select(F.concat_ws(",", F.concat(F.lit("﻿"), code), F.date_format("l_shipdate", "yyyyMMdd"), "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("string"), F.col("l_extendedprice").cast("string")).alias("value"))


def parse_card(lines):
    f = F.split("value", "[,]", -1)
    rows = lines.select(clean_code(f[0]).alias("code"), F.concat_ws("-", F.substring(f[1], 1, 4), F.substring(f[1], 5, 2)).alias("month"), f[2].alias("sector"), f[3].alias("status"), field_number(f[4]).cast("int").alias("line"), field_number(f[5]).alias("txns"), field_number(f[6]).alias("amount"))
    return I.valid_codes(rows)


def card_rows(spark, d):
    """Card sales as typed rows."""
    t = table(spark, d, "lineitem")
    code = F.lpad((F.col("l_suppkey") % 25).cast("string"), 10, "0")
    return t.select(code.alias("code"), F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.col("l_returnflag").alias("sector"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("double").alias("txns"), F.col("l_extendedprice").cast("double").alias("amount"))


def card_sql(body: str) -> str:
    return f"WITH {_CARD} {body}"


def sqlr(expression: str, digits: int, name: str) -> str:
    scale = 10.0**digits
    return f"floor(({expression}) * {scale} + 0.5) / {scale} AS {name}"


def share(cond: str, name: str, base: str = "true") -> str:
    b = f"sum(CASE WHEN {base} THEN amount ELSE 0 END)"
    return sqlr(f"CASE WHEN {b} > 0 THEN sum(CASE WHEN {cond} THEN amount ELSE 0 END) / {b} * 100 END", 1, name)


@query("agg_card_sum", card_sql(f"SELECT code, month, {sqlr('sum(amount) / 1e6', 1, 'card_sales')}, sum(txns)::BIGINT AS card_txns FROM card GROUP BY 1, 2"))
def agg_card_sum(spark, d):
    return I.card_totals(card_rows(spark, d))


_OWN = "status = 'O'"
_DEMOG = ", ".join([share(f"line <= 2 AND {_OWN}", "youth", _OWN), share(f"line >= 6 AND {_OWN}", "senior", _OWN), share("status = 'F'", "corporate"), sqlr("sum(amount) / 1e6", 1, "card_sales")])


@query("agg_share_demog", card_sql(f"SELECT code, month, {_DEMOG} FROM card GROUP BY 1, 2"))
def agg_share_demog(spark, d):
    own = F.col("status") == "O"
    return I.shares(card_rows(spark, d), {"youth": own & (F.col("line") <= 2), "senior": own & (F.col("line") >= 6), "corporate": F.col("status") == "F"}, {"youth": own, "senior": own})


@query("agg_share_industry", card_sql(f"SELECT code, month, {share('sector = ' + repr('A'), 'food')}, {share('sector = ' + repr('N'), 'retail')}, {share('sector = ' + repr('R'), 'health')}, {sqlr('sum(amount) / 1e6', 1, 'card_sales')} FROM card GROUP BY 1, 2"))
def agg_share_industry(spark, d):
    return I.shares(card_rows(spark, d), {n: F.col("sector") == s for n, s in (("food", "A"), ("retail", "N"), ("health", "R"))})


@query("agg_share_store", card_sql(f"SELECT code, month, {share('line IN (1, 3)', 'restaurant')}, {share('line = 2', 'cafe')}, {share('line IN (4, 5)', 'grocery')}, {sqlr('sum(amount) / 1e6', 1, 'card_sales')} FROM card GROUP BY 1, 2"))
def agg_share_store(spark, d):
    """Sub-industry codes go to store groups by a fixed map."""
    groups = F.create_map(*[F.lit(x) for k, v in {1: "restaurant", 3: "restaurant", 2: "cafe", 4: "grocery", 5: "grocery"}.items() for x in (k, v)])
    rows = card_rows(spark, d).withColumn("store", groups[F.col("line")])
    return I.shares(rows, {n: F.coalesce(F.col("store") == n, F.lit(False)) for n in ("restaurant", "cafe", "grocery")})


_EVENTS = "ev AS (SELECT lpad((user_id % 25)::VARCHAR, 10, '0') AS code, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%d') AS date, hour(ts) AS hour, value AS amount, coalesce(value, 0) + (user_id % 7) AS total, (user_id % 7)::DOUBLE AS elderly FROM events)"


def event_rows(spark, d):
    t = table(spark, d, "events")
    band = (F.col("user_id") % 7).cast("double")
    return t.select(F.lpad((F.col("user_id") % 25).cast("string"), 10, "0").alias("code"), F.date_format("ts", "yyyy-MM").alias("month"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.hour("ts").alias("hour"), F.col("value").alias("amount"), (F.coalesce("value", F.lit(0.0)) + band).alias("total"), band.alias("elderly"))


@query("agg_share_hourly", f"WITH {_EVENTS} SELECT code, month, {sqlr('sum(CASE WHEN hour BETWEEN 9 AND 18 THEN amount ELSE 0 END) / 1e6', 1, 'day_sales')}, {sqlr('sum(CASE WHEN hour >= 22 OR hour <= 5 THEN amount ELSE 0 END) / 1e6', 1, 'night_sales')}, {share('hour >= 22 OR hour <= 5', 'night_share')} FROM ev GROUP BY 1, 2")
def agg_share_hourly(spark, d):
    return I.hourly(event_rows(spark, d))


@query("agg_living", f"WITH {_EVENTS} SELECT code, month, {sqlr('sum(total) / count(*)', 0, 'living_total')}, {sqlr('CASE WHEN sum(total) > 0 THEN sum(elderly) / sum(total) * 100 END', 1, 'elderly_ratio')} FROM ev GROUP BY 1, 2")
def agg_living(spark, d):
    return I.living(event_rows(spark, d))


_DAY, _NIGHT = "avg(total) FILTER (hour BETWEEN 9 AND 18)", "avg(total) FILTER (hour >= 22 OR hour <= 5)"


@query("agg_daynight", f"WITH {_EVENTS} SELECT code, month, {sqlr(_DAY, 0, 'day_population')}, {sqlr(_NIGHT, 0, 'night_population')}, {sqlr(f'CASE WHEN {_NIGHT} > 0 THEN {_DAY} / {_NIGHT} * 100 END', 1, 'day_night_ratio')} FROM ev GROUP BY 1, 2")
def agg_daynight(spark, d):
    return I.day_night(event_rows(spark, d))


@query("agg_mobility", f"WITH {_EVENTS} SELECT code, month, {sqlr('sum(total) / count(DISTINCT date)', 0, 'daily')} FROM ev GROUP BY 1, 2")
def agg_mobility(spark, d):
    return I.daily_mean(event_rows(spark, d))


@query("join_flow_outer", f"WITH {_EVENTS}, i AS (SELECT code, month, {sqlr('sum(total) / count(DISTINCT date)', 0, 'inflow_total')} FROM ev WHERE hour < 12 GROUP BY 1, 2), o AS (SELECT code, month, {sqlr('sum(total) / count(DISTINCT date)', 0, 'outflow_total')} FROM ev WHERE hour >= 12 GROUP BY 1, 2) SELECT code, month, inflow_total, outflow_total, inflow_total - outflow_total AS net_flow FROM i FULL JOIN o USING (code, month)")
def join_flow_outer(spark, d):
    rows = event_rows(spark, d)
    return I.both_flows(I.daily_mean(rows.filter("hour < 12")), I.daily_mean(rows.filter("hour >= 12")))


_CREDIT = "cr AS (SELECT lpad(c_nationkey::VARCHAR, 10, '0') AS code, c_mktsegment AS band, 1 + c_custkey % 5 AS pop, abs(c_acctbal) AS income, 500 + c_custkey % 400 AS score, c_custkey % 2 AS holders, abs(c_acctbal) * 3 AS spend, c_custkey % 3 AS economic FROM customer)"


def credit_rows(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    return c.select(F.lpad(F.col("c_nationkey").cast("string"), 10, "0").alias("code"), F.col("c_mktsegment").alias("band"), (1 + k % 5).alias("pop"), F.abs("c_acctbal").alias("income"), (500 + k % 400).alias("score"), (k % 2).alias("holders"), (F.abs("c_acctbal") * 3).alias("spend"), (k % 3).alias("economic"))


def _credit_sql(keys: str, shown: str) -> str:
    when = lambda e: f"CASE WHEN {shown} THEN {e} END"
    return f"WITH {_CREDIT} SELECT {keys}, sum(pop)::BIGINT AS pop_total, {sqlr(when('sum(income * pop) / sum(pop)'), 0, 'avg_income')}, {sqlr(when('sum(score * pop) / sum(pop)'), 0, 'credit_score')}, {sqlr(when('sum(holders) / sum(pop) * 100'), 1, 'loan_ratio')}, {sqlr(when('sum(spend) / nullif(sum(economic), 0)'), 0, 'card_spend')} FROM cr GROUP BY {keys}"


@query("agg_credit", _credit_sql("code", "sum(pop) > 0"))
def agg_credit(spark, d):
    return I.credit(credit_rows(spark, d), ["code"])


@query("agg_grid", _credit_sql("code, band", "sum(pop) >= 30"))
def agg_grid(spark, d):
    """Averages of small groups are suppressed; the population is kept."""
    return I.credit(credit_rows(spark, d), ["code", "band"], I.LEAST_ADULTS)


_FLOW = "fl AS (SELECT year(o_orderdate) || quarter(o_orderdate)::VARCHAR AS quarter, lpad(c.c_nationkey::VARCHAR, 10, '0') AS home, lpad(s.s_nationkey::VARCHAR, 10, '0') AS work, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey GROUP BY ALL)"


def flow_rows(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.concat(F.year("o_orderdate").cast("string"), F.quarter("o_orderdate").cast("string")).alias("quarter"))
    home = table(spark, d, "customer").select("c_custkey", F.lpad(F.col("c_nationkey").cast("string"), 10, "0").alias("home"))
    work = table(spark, d, "supplier").select("s_suppkey", F.lpad(F.col("s_nationkey").cast("string"), 10, "0").alias("work"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(home, F.col("o_custkey") == F.col("c_custkey")).join(work, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy("quarter", "home", "work").agg(F.count(F.lit(1)).alias("n"))


@query("agg_commute", f"WITH {_FLOW}, j AS (SELECT quarter, work AS code, sum(n) AS jobs_in FROM fl GROUP BY 1, 2), h AS (SELECT quarter, home AS code, sum(n) AS workers, sum(CASE WHEN home <> work THEN n ELSE 0 END) AS outbound FROM fl GROUP BY 1, 2) SELECT quarter, code, coalesce(jobs_in, 0)::BIGINT AS jobs_in, {sqlr('CASE WHEN workers > 0 THEN outbound / workers * 100 END', 1, 'outbound_ratio')}, {sqlr('CASE WHEN workers > 0 THEN coalesce(jobs_in, 0) / workers * 100 END', 1, 'job_ratio')} FROM j FULL JOIN h USING (quarter, code)")
def agg_commute(spark, d):
    return I.commute(flow_rows(spark, d))


_MOVE = "mv AS (SELECT quarter, lpad((home::INT % 5)::VARCHAR, 5, '0') AS previous, lpad((work::INT % 5)::VARCHAR, 5, '0') AS current, lpad((work::INT % 5)::VARCHAR, 5, '0') || lpad(work::INT::VARCHAR, 5, '0') AS code, n FROM fl)"


def _moves(spark, d):
    home, work = F.col("home").cast("int"), F.col("work").cast("int")
    pad = lambda c: F.lpad(c.cast("string"), 5, "0")
    return flow_rows(spark, d).select("quarter", pad(home % 5).alias("previous"), pad(work % 5).alias("current"), F.concat(pad(work % 5), pad(work)).alias("code"), "n")


@query("flt_external_move", f"WITH {_FLOW}, {_MOVE} SELECT quarter, sum(n)::BIGINT AS n FROM mv WHERE previous <> '99999' AND previous <> current GROUP BY 1")
def flt_external_move(spark, d):
    return I.external_moves(_moves(spark, d)).groupBy("quarter").agg(F.sum("n").alias("n"))


@query("join_two_grain", with_ctes("cells", f"WITH {_FLOW}, {_MOVE}, m AS (SELECT * FROM mv WHERE previous <> current), i AS (SELECT quarter, code, sum(n) AS move_in FROM m GROUP BY 1, 2), o AS (SELECT quarter, previous AS sgg, sum(n)::BIGINT AS move_out_sgg FROM m GROUP BY 1, 2), g AS (SELECT code, sgg, quarter FROM cells, (SELECT DISTINCT quarter FROM m)) SELECT quarter, code, coalesce(move_in, 0)::BIGINT AS move_in, move_out_sgg FROM g LEFT JOIN i USING (quarter, code) LEFT JOIN o USING (quarter, sgg)"))
def join_two_grain(spark, d):
    return I.migration(_moves(spark, d), cells(spark, d))


_REG = "reg AS (SELECT lpad((o_custkey % 25)::VARCHAR, 10, '0') AS code, strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS tong, o_orderkey % 10 AS ban, o_orderkey AS seq, o_totalprice AS population FROM orders UNION ALL SELECT lpad((o_custkey % 25)::VARCHAR, 10, '0'), strftime(o_orderdate, '%Y-%m'), o_orderpriority, o_orderkey % 10, o_orderkey + 100000000, o_totalprice + 1 FROM orders)"


def registry_rows(spark, d):
    o = table(spark, d, "orders")
    base = o.select(F.lpad((F.col("o_custkey") % 25).cast("string"), 10, "0").alias("code"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("tong"), (F.col("o_orderkey") % 10).alias("ban"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("population"))
    return base.unionByName(base.withColumn("seq", F.col("seq") + 100000000).withColumn("population", F.col("population") + 1))


@query("agg_dedup_last", f"WITH {_REG} SELECT code, month, tong, ban, max_by(population, seq) AS population FROM reg GROUP BY ALL")
def agg_dedup_last(spark, d):
    return I.dedup_last(registry_rows(spark, d), ["code", "month", "tong", "ban"], "seq").drop("seq")


@query("agg_group_month", f"WITH {_REG}, l AS (SELECT code, month, tong, ban, max_by(population, seq) AS population FROM reg GROUP BY ALL) SELECT code, month, {sqlr('sum(population)', 3, 'population')}, count(*) AS rows FROM l GROUP BY 1, 2")
def agg_group_month(spark, d):
    last = I.dedup_last(registry_rows(spark, d), ["code", "month", "tong", "ban"], "seq")
    return last.groupBy("code", "month").agg(half_up(F.sum("population"), 3).alias("population"), F.count(F.lit(1)).alias("rows"))


@query("agg_distinct_facility", f"WITH {_REG} SELECT code, tong, min(seq) AS seq FROM reg GROUP BY 1, 2")
def agg_distinct_facility(spark, d):
    """First row of each key."""
    return I.dedup_first(registry_rows(spark, d), ["code", "tong"], "seq").select("code", "tong", "seq")


@query("agg_age_bucket", "SELECT lpad(c_nationkey::VARCHAR, 10, '0') AS code, sum(CASE WHEN c_custkey % 100 <= 14 THEN 1 ELSE 0 END)::BIGINT AS youth, sum(CASE WHEN c_custkey % 100 BETWEEN 15 AND 64 THEN 1 ELSE 0 END)::BIGINT AS working, sum(CASE WHEN c_custkey % 100 >= 65 THEN 1 ELSE 0 END)::BIGINT AS elderly FROM customer GROUP BY 1")
def agg_age_bucket(spark, d):
    rows = table(spark, d, "customer").select(F.lpad(F.col("c_nationkey").cast("string"), 10, "0").alias("code"), (F.col("c_custkey") % 100).alias("age"), F.lit(1).cast("long").alias("n"))
    return I.age_buckets(rows)


@query("agg_wide_ages", with_ctes("series", "SELECT code, band, sum(n)::BIGINT AS n FROM (SELECT code, 'youth' AS band, youth AS n FROM series UNION ALL SELECT code, 'working', working FROM series UNION ALL SELECT code, 'elderly', elderly FROM series) GROUP BY 1, 2"))
def agg_wide_ages(spark, d):
    """Age columns to rows."""
    return region_series(spark, d).unpivot(["code"], ["youth", "working", "elderly"], "band", "n").groupBy("code", "band").agg(F.sum("n").alias("n"))


@query("agg_oneperson", with_ctes("series", "SELECT code, month, coalesce(one_person, households - population) AS one_person FROM series"))
def agg_oneperson(spark, d):
    return region_series(spark, d).select("code", "month", F.coalesce("one_person", F.col("households") - F.col("population")).alias("one_person"))


@query("join_pop_merge", with_ctes("series", "SELECT code, month_no, population AS partial, population + 5 + month_no % 3 AS whole FROM series"))
def join_pop_merge(spark, d):
    """An update that lacks one month leaves the base as it is; one that has all replaces it."""
    base = region_series(spark, d).select("code", "month_no", "population")
    update = base.withColumn("population", F.col("population") + 5 + F.col("month_no") % 3)
    keys = ["code", "month_no"]
    partial = I.merge_all_or_nothing(base, update.filter("month_no <> 24012"), keys, "population").withColumnRenamed("population", "partial")
    return partial.join(I.merge_all_or_nothing(base, update, keys, "population").withColumnRenamed("population", "whole"), keys)


@query("join_vitals_merge", with_ctes("series", "SELECT code, month_no, CASE WHEN month_no = 24012 THEN 0 ELSE births END AS births FROM series"))
def join_vitals_merge(spark, d):
    base = region_series(spark, d).select("code", "month_no", "births")
    return I.merge_with_zero(base, base.filter("month_no <> 24012"), ["code", "month_no"], "births")


@query("join_required", with_ctes("series", "SELECT code, month_no, births, population * 2 + month_no % 7 AS population FROM series WHERE month_no > 24009"))
def join_required(spark, d):
    """The later months with values from a table of all months."""
    series, keys = region_series(spark, d), ["code", "month_no"]
    values = series.select(*keys, (F.col("population") * 2 + F.col("month_no") % 7).alias("population"))
    return I.join_required(series.filter("month_no > 24009").select(*keys, "births"), values, keys, "population")


@query("agg_coverage", with_ctes("facilities", "WITH g AS (SELECT code, count(*) FILTER (id % 10 < 9) AS covered, count(*) AS total FROM facilities GROUP BY 1) SELECT code, covered, total FROM g WHERE covered >= 0.9 * total"))
def agg_coverage(spark, d):
    counted = facilities(spark, d).groupBy("code").agg(F.count_if(F.col("id") % 10 < 9).alias("covered"), F.count(F.lit(1)).alias("total"))
    return counted.filter(F.col("covered") >= I.COVERAGE * F.col("total"))


_DIGEST = "sha256(to_json(struct_pack(births, code, deaths, elderly, households, month, month_no, population, working, youth)))"
_SUMS = ", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT)::VARCHAR AS s{i}" for i in range(8))


@query("sink_checksum", with_ctes("series", f"WITH x AS (SELECT {_DIGEST} AS h FROM series), p AS (SELECT {_SUMS} FROM x) SELECT sha256(concat_ws('|', {', '.join(f's{i}' for i in range(8))})) AS checksum FROM p"))
def sink_checksum(spark, d):
    """One-person households, null in some rows, are left out: JSON has nulls in the one engine and not in the other."""
    return checksum(region_series(spark, d).drop("one_person"))
