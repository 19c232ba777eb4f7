"""Queries of real feed files and jobs: files are written from the driver's tables, read, summed, joined with the boundary and published as JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from sanmaru.functions import codes as K
from sanmaru.functions.geo import bin_key
from sanmaru.functions.numeric import half_up
from sanmaru.operators import ingest as I
from sanmaru.plans import ingest_queries as Q
from sanmaru.plans.cube_queries import r6, sql6
from sanmaru.plans.registry import query
from sanmaru.session import shared_path, written
from sanmaru.sources import readers as R
from sanmaru.sources import discovery as V
from sanmaru.sources import sinks as S
from sanmaru.sources.bindings import cells, facilities, monthly_cube, table, with_ctes

CARD_FIELDS = ["code", "date", "sector", "status", "line", "txns", "amount"]


def put(df, name, **options):
    """Write ``df`` as a pipe-separated feed with a header and return its path."""
    path = shared_path(df.sparkSession, name)
    df.write.options(sep="|", header=True, **options).csv(path)
    return path


def card_file(spark, d):
    path = shared_path(spark, "card")
    Q.card_lines(spark, d).write.text(path)
    return path


def read_card(spark, path):
    t = R.read_headerless(spark, path, CARD_FIELDS)
    return Q.parse_card(t.select(F.concat_ws(",", *CARD_FIELDS).alias("value")))


# Headerless files.
@query("src_csv_headerless", Q.card_sql(f"SELECT code, month, count(*) AS lines, {Q.sqlr('sum(txns)', 0, 'txns')} FROM card GROUP BY 1, 2"))
def src_csv_headerless(spark, d):
    return read_card(spark, card_file(spark, d)).groupBy("code", "month").agg(F.count(F.lit(1)).alias("lines"), half_up(F.sum("txns"), 0).alias("txns"))


@query("src_csv_headerless_demog", Q.card_sql(f"SELECT code, status, line, count(*) AS lines, {Q.sqlr('sum(amount)', 1, 'amount')} FROM card GROUP BY 1, 2, 3"))
def src_csv_headerless_demog(spark, d):
    """Cell, holder and age band of each line."""
    return read_card(spark, card_file(spark, d)).groupBy("code", "status", "line").agg(F.count(F.lit(1)).alias("lines"), half_up(F.sum("amount"), 1).alias("amount"))


def hourly_file(spark, d):
    """Code, holder, date, hour (without its leading zero) and amount; rows without an amount aren't delivered."""
    e = Q.event_rows(spark, d).filter("amount is not null")
    path = shared_path(spark, "hourly")
    e.select(F.concat_ws(",", "code", F.lit("P"), F.regexp_replace("date", "-", ""), F.col("hour").cast("string"), F.col("amount").cast("string")).alias("value")).write.text(path)
    return path


def read_hourly(spark, path):
    t = R.read_headerless(spark, path, ["code", "holder", "date", "hour", "amount"])
    month = K.normal_month(F.substring("date", 1, 6))
    rows = t.select(K.clean_code(F.col("code")).alias("code"), month.alias("month"), K.hour_label(F.col("hour")).cast("int").alias("hour"), K.field_number(F.col("amount")).alias("amount"))
    return I.valid_codes(rows).filter("amount is not null")


@query("src_csv_headerless_hourly", f"WITH {Q._EVENTS} SELECT code, hour::INT AS hour, count(*) AS lines, {Q.sqlr('sum(amount)', 1, 'amount')} FROM ev WHERE amount IS NOT NULL GROUP BY 1, 2")
def src_csv_headerless_hourly(spark, d):
    return read_hourly(spark, hourly_file(spark, d)).groupBy("code", "hour").agg(F.count(F.lit(1)).alias("lines"), half_up(F.sum("amount"), 1).alias("amount"))


# Pipe-separated files.
_EV8 = "ev AS (SELECT lpad((user_id % 25)::VARCHAR, 8, '0') || '00' AS code, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%d') AS date, hour(ts) AS hour, coalesce(value, 0) + (user_id % 7) AS total, (user_id % 7)::DOUBLE AS elderly FROM events)"


def _people(spark, d):
    """Events as feed rows; ``ym`` becomes a folder."""
    e = Q.event_rows(spark, d)
    return e.select(F.regexp_replace("month", "-", "").alias("ym"), F.substring("code", 3, 8).alias("cell"), F.col("hour").cast("string").alias("hour"), "date", (F.col("total") - F.col("elderly")).alias("young"), "elderly", F.col("hour").alias("h"))


def _by_month(df, name):
    path = shared_path(df.sparkSession, name)
    df.write.partitionBy("ym").options(sep="|", header=True).csv(path)
    return path


def living_file(spark, d):
    return _by_month(_people(spark, d).select("ym", F.col("cell").alias("ADMDONG_CD"), F.col("hour").alias("TIMEZN_CD"), F.col("young").alias("M00"), F.col("elderly").alias("F70")), "living")


def day_night_file(spark, d):
    return _by_month(_people(spark, d).select("ym", F.col("hour").alias("TIMEZN_CD"), F.col("cell").alias("ADMDONG_CD"), F.col("young").alias("band_1"), F.col("elderly").alias("band_2")), "daynight")


def flow_files(spark, d):
    """Inflow names its cell ADM_CD, outflow RSDN_ADM_CD."""
    p = _people(spark, d)
    make = lambda rows, cell: rows.select("ym", F.col("date").alias("BASE_DATE"), F.col("cell").alias(cell), F.lit("00000").alias("SGG_CD"), F.col("young").alias("M00"), F.col("elderly").alias("F70"))
    return _by_month(make(p.filter("h < 12"), "ADM_CD"), "inflow"), _by_month(make(p.filter("h >= 12"), "RSDN_ADM_CD"), "outflow")


@query("src_psv_living", f"WITH {_EV8} SELECT code, month, count(*) AS rows, {Q.sqlr('sum(total)', 3, 'total')}, {Q.sqlr('sum(elderly)', 3, 'elderly')} FROM ev GROUP BY 1, 2")
def src_psv_living(spark, d):
    return R.read_living(spark, living_file(spark, d)).groupBy("code", "month").agg(F.count(F.lit(1)).alias("rows"), half_up(F.sum("total"), 3).alias("total"), half_up(F.sum("elderly"), 3).alias("elderly"))


@query("src_psv_daynight", f"WITH {_EV8} SELECT code, month, hour::INT AS hour, count(*) AS rows, {Q.sqlr('sum(total)', 3, 'total')} FROM ev GROUP BY 1, 2, 3")
def src_psv_daynight(spark, d):
    return R.read_day_night(spark, day_night_file(spark, d)).groupBy("code", "month", "hour").agg(F.count(F.lit(1)).alias("rows"), half_up(F.sum("total"), 3).alias("total"))


@query("src_psv_mobility", f"WITH {_EV8} SELECT code, date, CASE WHEN hour < 12 THEN 'in' ELSE 'out' END AS way, count(*) AS rows, {Q.sqlr('sum(total)', 3, 'total')} FROM ev GROUP BY 1, 2, 3")
def src_psv_mobility(spark, d):
    inflow, outflow = (R.read_mobility(spark, p) for p in flow_files(spark, d))
    both = inflow.withColumn("way", F.lit("in")).union(outflow.withColumn("way", F.lit("out")))
    return both.groupBy("code", "date", "way").agg(F.count(F.lit(1)).alias("rows"), half_up(F.sum("total"), 3).alias("total"))


CREDIT = ["CRTR_YM", "ADM_CD", "SEG", "POP", "INCOME", "SCORE", "HOLDERS", "SPEND", "ECONOMIC"]
_CR8 = Q._CREDIT.replace("lpad(c_nationkey::VARCHAR, 10, '0') AS code", "lpad(c_nationkey::VARCHAR, 8, '0') || '00' AS code, '2001-07' AS month")


def credit_file(spark, d):
    c = Q.credit_rows(spark, d)
    return put(c.select(F.lit("200107").alias("CRTR_YM"), F.substring("code", 3, 8).alias("ADM_CD"), F.col("band").alias("SEG"), *[F.col(n.lower()).alias(n) for n in CREDIT[3:]]), "credit")


def read_credit(rows):
    number = [K.field_number(F.col(n)).alias(n.lower()) for n in CREDIT[4:]]
    return rows.select(K.pad_code(F.col("ADM_CD")).alias("code"), K.normal_month(F.col("CRTR_YM")).alias("month"), F.col("SEG").alias("band"), K.field_number(F.col("POP")).cast("long").alias("pop"), *number)


@query("src_psv_header", f"WITH {_CR8} SELECT code, band, count(*) AS rows, sum(pop)::BIGINT AS pop, {Q.sqlr('sum(income)', 1, 'income')} FROM cr GROUP BY 1, 2")
def src_psv_header(spark, d):
    rows = read_credit(R.read_psv(spark, credit_file(spark, d), CREDIT))
    return rows.groupBy("code", "band").agg(F.count(F.lit(1)).alias("rows"), F.sum("pop").alias("pop"), half_up(F.sum("income"), 1).alias("income"))


@query("src_psv_stream", f"WITH {_CR8} SELECT code, sum(pop)::BIGINT AS pop, {Q.sqlr('sum(spend)', 1, 'spend')} FROM cr GROUP BY 1")
def src_psv_stream(spark, d):
    """The files of a month as a stream, whose batches append their sums."""
    path, out = credit_file(spark, d), shared_path(spark, "credit-sums")
    schema = ", ".join(f"{c} string" for c in CREDIT)
    stream = spark.readStream.schema(schema).options(sep="|", header=True, maxFilesPerTrigger=100).csv(path)

    def fold(batch, number):
        I.credit_sums(read_credit(batch), ["code"]).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(fold).option("checkpointLocation", shared_path(spark, "credit-marks")).trigger(availableNow=True).start().awaitTermination()
    sums = I.add_sums(spark.read.parquet(out).drop("batch"), keys=["code"])
    return sums.select("code", "pop", half_up(F.col("spend"), 1).alias("spend"))


# The grid: CP949 files by centroids.
RESOLUTION, GRIDS = 500, 350
_GRID = f"""g AS (SELECT c_custkey % 400 AS g, 1 + c_custkey % 5 AS pop, abs(c_acctbal) AS income, 500 + c_custkey % 400 AS score, c_custkey % 2 AS holders, abs(c_acctbal) * 3 AS spend, c_custkey % 3 AS economic FROM customer),
 cr AS (SELECT *, (1000050 + g % 20 * 100) // {RESOLUTION} || '_' || (1700050 + g // 20 * 100) // {RESOLUTION} AS code FROM g WHERE g < {GRIDS} - 10)"""


def grid_file(spark, d):
    """Grid identifiers are Korean; the file is CP949."""
    R.allow_java_charsets(spark)
    k, amount = F.col("c_custkey"), F.abs("c_acctbal")
    gid = F.concat(F.lit("다라"), F.lpad((k % 400).cast("string"), 4, "0"))
    fields = {"CRTR_YM": F.lit("200107"), "GRID_100M_ID": gid, "POP": 1 + k % 5, "INCOME": amount, "SCORE": 500 + k % 400, "HOLDERS": k % 2, "SPEND": amount * 3, "ECONOMIC": k % 3}
    return put(table(spark, d, "customer").select(*[v.alias(n) for n, v in fields.items()]), "grid", encoding="x-windows-949")


def centroid_file(spark, d):
    """The squares under 350 in which customers live; ten of them without an x."""
    g = F.col("id")
    x = F.when(g < GRIDS - 10, (1000050 + g % 20 * 100).cast("string")).otherwise("none")
    path = shared_path(spark, "centroids")
    squares = table(spark, d, "customer").select((F.col("c_custkey") % 400).alias("id")).distinct().filter(g < GRIDS)
    rows = squares.select(F.concat(F.lit("다라"), F.lpad(g.cast("string"), 4, "0")).alias("﻿gid"), x.alias("center_x_5179"), (1700050 + F.floor(g / 20) * 100).alias("center_y_5179"), (127.5 + g / 1000).alias("longitude"), (34.5 + g / 1000).alias("latitude"))
    rows.write.option("header", True).csv(path)
    return path


def read_grid(spark, path):
    names = ["CRTR_YM", "GRID_100M_ID", *CREDIT[3:]]
    t = R.read_psv(spark, path, names, "x-windows-949")
    return t.select(F.col("GRID_100M_ID").alias("gid"), K.normal_month(F.col("CRTR_YM")).alias("month"), K.field_number(F.col("POP")).cast("long").alias("pop"), *[K.field_number(F.col(n)).alias(n.lower()) for n in CREDIT[4:]])


@query("src_cp949_grid", "SELECT '다라' || lpad((c_custkey % 400)::VARCHAR, 4, '0') AS gid, count(*) AS rows, sum(1 + c_custkey % 5)::BIGINT AS pop FROM customer GROUP BY 1")
def src_cp949_grid(spark, d):
    return read_grid(spark, grid_file(spark, d)).groupBy("gid").agg(F.count(F.lit(1)).alias("rows"), F.sum("pop").alias("pop"))


@query("src_centroids", f"SELECT '다라' || lpad(g::VARCHAR, 4, '0') AS gid, (1000050 + g % 20 * 100)::DOUBLE AS x, (1700050 + g // 20 * 100)::DOUBLE AS y, {sql6('127.5::DOUBLE + g / 1000', 'lon')}, {sql6('34.5::DOUBLE + g / 1000', 'lat')} FROM (SELECT DISTINCT c_custkey % 400 AS g FROM customer) WHERE g < {GRIDS} - 10")
def src_centroids(spark, d):
    return R.read_centroids(spark, centroid_file(spark, d)).select("gid", "x", "y", r6("lon"), r6("lat"))


@query("src_dir_discovery", "SELECT strftime(o_orderdate, '%Y%m') AS folder, count(*) AS rows FROM orders WHERE month(o_orderdate) % 3 > 0 AND year(o_orderdate) > 1996 GROUP BY 1")
def src_dir_discovery(spark, d):
    """All months delivered in one write; some folders hold another file only, and the years up to 1996 were taken by an earlier run."""
    root, manifest = shared_path(spark, "delivery"), shared_path(spark, "manifest")
    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyyMM").alias("month"), F.when(F.month("o_orderdate") % 3 > 0, "grid_stat").otherwise("other").alias("file"), F.col("o_orderkey").cast("string"))
    o.repartition("month", "file").write.partitionBy("month", "file").text(root)
    early = written(V.new_folders(spark, root, "file=grid_stat", manifest).filter("folder < 'month=1997'"))
    V.mark_seen(early, manifest)
    later = written(V.new_folders(spark, root, "file=grid_stat", manifest))
    rows = spark.read.text(root).filter("file = 'grid_stat'").withColumn("folder", F.concat(F.lit("month="), F.col("month")))
    return rows.join(F.broadcast(later), "folder", "left_semi").groupBy(F.substring("folder", 7, 6).alias("folder")).agg(F.count(F.lit(1)).alias("rows"))  # a row for each month


# Finishing sums that came from two files.
def _two(rows, cond):
    return rows.filter(cond), rows.filter(~cond)


def _parts(name):
    own, line = F.col("status") == "O", F.col("line")
    if name == "demog":
        return {"youth": own & (line <= 2), "senior": own & (line >= 6), "corporate": F.col("status") == "F"}, {"youth": own, "senior": own}
    if name == "industry":
        return {n: F.col("sector") == s for n, s in (("food", "A"), ("retail", "N"), ("health", "R"))}, None
    return {n: line.isin(*v) for n, v in (("restaurant", [1, 3]), ("cafe", [2]), ("grocery", [4, 5]))}, None


KEYS = ["code", "month"]


def _finished(rows, name):
    parts, base = _parts(name)
    return I.finish_shares(I.add_sums(*[I.share_sums(part, parts, base) for part in _two(rows, F.col("line") % 2 == 1)], keys=KEYS))


def _sql(name):
    from sanmaru.plans import registry

    return registry._SQL[name]


@query("agg_share_demog_fin", _sql("agg_share_demog"))
def agg_share_demog_fin(spark, d):
    return _finished(Q.card_rows(spark, d), "demog")


@query("agg_share_industry_fin", _sql("agg_share_industry"))
def agg_share_industry_fin(spark, d):
    return _finished(Q.card_rows(spark, d), "industry")


@query("agg_share_store_fin", _sql("agg_share_store"))
def agg_share_store_fin(spark, d):
    return _finished(Q.card_rows(spark, d), "store")


@query("agg_share_hourly_fin", _sql("agg_share_hourly"))
def agg_share_hourly_fin(spark, d):
    return I.finish_hourly(I.add_sums(*map(I.hourly_sums, _two(Q.event_rows(spark, d), F.col("hour") < 7)), keys=KEYS))


@query("agg_credit_fin", _sql("agg_credit"))
def agg_credit_fin(spark, d):
    return I.finish_credit(I.add_sums(*[I.credit_sums(r, ["code"]) for r in _two(Q.credit_rows(spark, d), F.col("holders") == 1)], keys=["code"]), ["code"])


@query("agg_grid_fin", _sql("agg_grid"))
def agg_grid_fin(spark, d):
    keys = ["code", "band"]
    return I.finish_credit(I.add_sums(*[I.credit_sums(r, keys) for r in _two(Q.credit_rows(spark, d), F.col("holders") == 1)], keys=keys), keys, I.LEAST_ADULTS)


@query("agg_commute_fin", _sql("agg_commute"))
def agg_commute_fin(spark, d):
    return I.finish_commute(I.add_sums(*map(I.commute_sums, _two(Q.flow_rows(spark, d), F.col("home") < "0000000010")), keys=["quarter", "code"]))


# Jobs: reader, sums, boundary join, sink.
_BND = {10: "lpad(n_nationkey::VARCHAR, 10, '0')", 8: "lpad(n_nationkey::VARCHAR, 8, '0') || '00'"}


def published(rows, d, layer, metrics, width=10):
    """Rows of known cells, written as cube documents and read again."""
    spark = rows.sparkSession
    nation = table(spark, d, "nation").filter("n_nationkey < 20")  # 25 rows at any scale
    code = F.lpad(F.col("n_nationkey").cast("string"), width, "0")
    boundary = nation.select((code if width == 10 else K.pad_code(code)).alias("code"))
    known = rows.join(F.broadcast(boundary), "code").withColumn("month_no", K.month_no(F.col("month")))
    path = shared_path(spark, layer)
    S.write_cube_json(written(known.select("code", "month_no", *metrics)), layer, metrics, path)
    return R.read_cube_json(spark, path, metrics)


def published_sql(body, metrics, width=10):
    listed = ", ".join(f"{m}::DOUBLE AS {m}" for m in metrics)
    return f"SELECT code, (substr(month, 1, 4)::INT * 12 + substr(month, 6, 2)::INT - 1)::INT AS month_no, {listed} FROM ({body}) JOIN (SELECT {_BND[width]} AS code FROM nation WHERE n_nationkey < 20) USING (code) WHERE coalesce({', '.join(metrics)}) IS NOT NULL"


_CARD_METRICS = {
    "job_nh_consumption": ("agg_card_sum", ["card_sales", "card_txns"]), "job_nh_demographics": ("agg_share_demog", ["youth", "senior", "corporate", "card_sales"]),
    "job_nh_industry": ("agg_share_industry", ["food", "retail", "health", "card_sales"]), "job_nh_storetype": ("agg_share_store", ["restaurant", "cafe", "grocery", "card_sales"]),
    "job_nh_hourly": ("agg_share_hourly", ["day_sales", "night_sales", "night_share"]),
}


def _card_job_sql(name):
    source, metrics = _CARD_METRICS[name]
    return published_sql(_sql(source), metrics)


@query("job_nh_consumption", _card_job_sql("job_nh_consumption"))
def job_nh_consumption(spark, d):
    return published(I.card_totals(read_card(spark, card_file(spark, d))), d, "consumption", _CARD_METRICS["job_nh_consumption"][1])


@query("job_nh_demographics", _card_job_sql("job_nh_demographics"))
def job_nh_demographics(spark, d):
    return published(I.shares(read_card(spark, card_file(spark, d)), *_parts("demog")), d, "demographics", _CARD_METRICS["job_nh_demographics"][1])


@query("job_nh_industry", _card_job_sql("job_nh_industry"))
def job_nh_industry(spark, d):
    return published(I.shares(read_card(spark, card_file(spark, d)), *_parts("industry")), d, "industry", _CARD_METRICS["job_nh_industry"][1])


@query("job_nh_storetype", _card_job_sql("job_nh_storetype"))
def job_nh_storetype(spark, d):
    return published(I.shares(read_card(spark, card_file(spark, d)), *_parts("store")), d, "storetype", _CARD_METRICS["job_nh_storetype"][1])


@query("job_nh_hourly", _card_job_sql("job_nh_hourly").replace(" FROM events)", " FROM events WHERE value IS NOT NULL)"))
def job_nh_hourly(spark, d):
    return published(I.hourly(read_hourly(spark, hourly_file(spark, d))), d, "hourly", _CARD_METRICS["job_nh_hourly"][1])


def _people_sql(name, metrics):
    return published_sql(_sql(name).replace(Q._EVENTS, _EV8), metrics, 8)


_LIVING, _DAYNIGHT, _FLOWS = ["living_total", "elderly_ratio"], ["day_population", "night_population", "day_night_ratio"], ["inflow_total", "outflow_total", "net_flow"]


@query("job_skt_living", _people_sql("agg_living", _LIVING))
def job_skt_living(spark, d):
    return published(I.living(R.read_living(spark, living_file(spark, d))), d, "living", _LIVING, 8)


@query("job_skt_daynight", _people_sql("agg_daynight", _DAYNIGHT))
def job_skt_daynight(spark, d):
    return published(I.day_night(R.read_day_night(spark, day_night_file(spark, d))), d, "daynight", _DAYNIGHT, 8)


@query("job_skt_mobility", _people_sql("join_flow_outer", _FLOWS))
def job_skt_mobility(spark, d):
    inflow, outflow = (I.daily_mean(R.read_mobility(spark, p)) for p in flow_files(spark, d))
    return published(I.both_flows(inflow, outflow), d, "mobility", _FLOWS, 8)


_CREDIT_METRICS = ["pop_total", "avg_income", "credit_score", "loan_ratio", "card_spend"]


@query("job_kcb_credit", published_sql(Q._credit_sql("code, month", "sum(pop) > 0").replace(Q._CREDIT, _CR8), _CREDIT_METRICS, 8))
def job_kcb_credit(spark, d):
    rows = read_credit(R.read_psv(spark, credit_file(spark, d), CREDIT))
    return published(I.credit(rows, ["code", "month"]), d, "credit", _CREDIT_METRICS, 8)


_QUARTER = "substr(quarter, 1, 4) || '-' || lpad((substr(quarter, 5, 1)::INT * 3)::VARCHAR, 2, '0') AS month"
_COMMUTE, _MOVES = ["jobs_in", "outbound_ratio", "job_ratio"], ["move_in", "move_out_sgg"]


@query("job_kcb_commute", published_sql(f"SELECT *, {_QUARTER} FROM ({_sql('agg_commute')})", _COMMUTE))
def job_kcb_commute(spark, d):
    t = R.read_psv(spark, put(Q.flow_rows(spark, d), "commute"), ["quarter", "home", "work", "n"])
    rows = I.commute(t.withColumn("n", K.field_number(F.col("n")).cast("long")))
    return published(rows.withColumn("month", K.quarter_label(F.col("quarter"))), d, "commute", _COMMUTE)


@query("job_kcb_migration", f"SELECT code, (substr(quarter, 1, 4)::INT * 12 + substr(quarter, 5, 1)::INT * 3 - 1)::INT AS month_no, move_in::DOUBLE AS move_in, move_out_sgg::DOUBLE AS move_out_sgg FROM ({_sql('join_two_grain')})")
def job_kcb_migration(spark, d):
    """Cells come from the boundary here, so that one without arrivals has 0."""
    t = R.read_psv(spark, put(Q._moves(spark, d), "moves"), ["quarter", "previous", "current", "code", "n"])
    rows = I.migration(t.withColumn("n", K.field_number(F.col("n")).cast("long")), cells(spark, d))
    path = shared_path(spark, "migration")
    known = rows.select("code", K.month_no(K.quarter_label(F.col("quarter"))).alias("month_no"), *_MOVES)
    S.write_cube_json(written(known), "migration", _MOVES, path)
    return R.read_cube_json(spark, path, _MOVES)


_GRID_ROWS = Q._credit_sql("code", f"sum(pop) >= {I.LEAST_ADULTS}").replace(Q._CREDIT, _GRID)


@query("job_kcb_grid", f"SELECT code, 24018::INT AS month_no, {', '.join(f'{m}::DOUBLE AS {m}' for m in _CREDIT_METRICS)} FROM ({_GRID_ROWS})")
def job_kcb_grid(spark, d):
    """Squares without a centroid are dropped; bins of few adults keep their population only."""
    spots = F.broadcast(R.read_centroids(spark, centroid_file(spark, d)))  # squares of a province: a fixed number
    rows = read_grid(spark, grid_file(spark, d)).join(spots, "gid").withColumn("code", bin_key(F.col("x"), F.col("y"), RESOLUTION))
    out = I.credit(rows, ["code", "month"], I.LEAST_ADULTS).withColumn("month_no", K.month_no(F.col("month")))
    path = shared_path(spark, "grid-cube")
    S.write_cube_json(written(out.select("code", "month_no", *_CREDIT_METRICS)), "grid", _CREDIT_METRICS, path)
    return R.read_cube_json(spark, path, _CREDIT_METRICS)


# JSON and XML.
@query("src_cube_json", with_ctes("cube", "SELECT code, month_no, n::DOUBLE AS n FROM cube"))
def src_cube_json(spark, d):
    path = shared_path(spark, "cube")
    S.write_cube_json(written(monthly_cube(spark, d)), "orders", ["n"], path)
    return R.read_cube_json(spark, path, ["n"])


@query("sink_cube_json", with_ctes("cube", "WITH m AS (SELECT DISTINCT month_no FROM cube), g AS (SELECT code, month_no FROM (SELECT DISTINCT code FROM cube), m) SELECT 'orders' AS layer_id, code, count(*)::INT AS months, count(n)::INT AS known FROM g LEFT JOIN cube USING (code, month_no) GROUP BY 2"))
def sink_cube_json(spark, d):
    path = shared_path(spark, "cube")
    S.write_cube_json(written(monthly_cube(spark, d)), "orders", ["rev", "n"], path)
    docs = spark.read.schema("layer_id string, code string, months array<int>, series map<string, array<double>>").json(path)
    return docs.select("layer_id", "code", F.size("months").alias("months"), F.size(F.filter(F.element_at("series", "n"), lambda v: v.isNotNull())).alias("known"))


_ITEM = "struct<id:bigint,name:string>"


def _responses(spark, d, form):
    """One response for each supplier, in the form of ``form``."""
    item = "concat('{\"id\":', s_suppkey, ',\"name\":\"', s_name, '\"}')"
    path = shared_path(spark, "responses")
    table(spark, d, "supplier").select(F.expr(form.replace("ITEM", item)).alias("value")).write.text(path)
    return spark.read.text(path)


_ENVELOPE = "CASE s_suppkey % 3 WHEN 0 THEN concat('{\"response\":{\"header\":{\"resultCode\":\"00\"},\"body\":{\"items\":{\"item\":[', ITEM, ']}}}}') WHEN 1 THEN concat('{\"Response\":{\"head\":{\"resultCode\":\"0\"},\"items\":{\"item\":', ITEM, '}}}') ELSE concat('{\"response\":{\"body\":{\"items\":{\"item\":', ITEM, '}}}}') END"
_SUPPLIERS = "SELECT s_suppkey AS id, s_name AS name FROM supplier"


@query("src_rest_envelope", _SUPPLIERS)
def src_rest_envelope(spark, d):
    return R.parse_envelope(_responses(spark, d, _ENVELOPE), "value", _ITEM)


@query("src_rows_any", _SUPPLIERS)
def src_rows_any(spark, d):
    return R.rows_of(_responses(spark, d, f"CASE s_suppkey % 4 WHEN 0 THEN concat('[', ITEM, ']') WHEN 1 THEN concat('{{\"items\":[', ITEM, ']}}') ELSE {_ENVELOPE} END"), "value", _ITEM)


@query("src_rest_code", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 > 0 THEN CASE s_suppkey % 4 WHEN 1 THEN '0' WHEN 2 THEN '00' ELSE 'INFO-000' END END AS code FROM supplier")
def src_rest_code(spark, d):
    """Result codes under header, head or the response itself; some responses have none."""
    form = "concat('{\"response\":', CASE s_suppkey % 4 WHEN 0 THEN '{\"x\":1' WHEN 1 THEN '{\"header\":{\"resultCode\":\"0\"}' WHEN 2 THEN '{\"head\":{\"resultCode\":\"00\"}' ELSE '{\"resultCode\":\"INFO-000\"' END, ',\"id\":', s_suppkey, '}}')"
    rows = _responses(spark, d, form)
    return rows.select(F.try_variant_get(F.try_parse_json("value"), "$.response.id", "bigint").alias("id"), R.result_code("value").alias("code"))


@query("src_xml_parse", _SUPPLIERS)
def src_xml_parse(spark, d):
    path = shared_path(spark, "xml")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    s.write.format("xml").option("rootTag", "items").option("rowTag", "item").save(path)
    return R.read_xml_items(spark, path, s.schema)


@query("src_pg_read", "SELECT o_orderkey AS id, o_totalprice AS payload FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 > 0 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def src_pg_read(spark, d):
    o = table(spark, d, "orders").withColumn("created_at", F.struct("o_orderdate", "o_orderkey")).withColumn("is_published", F.col("o_orderkey") % 3 > 0).withColumn("mode", F.when(F.col("o_orderstatus") == "F", "live").otherwise("demo"))
    return R.newest_published(o, "live").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("payload"))


@query("src_version_pick", "SELECT max(strftime(o_orderdate, '%Y%m%d')) AS version FROM orders")
def src_version_pick(spark, d):
    """Names of other forms and days that don't exist are passed over."""
    o = table(spark, d, "orders").select(F.concat(F.lit("ver"), F.date_format("o_orderdate", "yyyyMMdd")).alias("name"))
    odd = spark.createDataFrame([("ver20991399",), ("ver20990231",), ("v20990101",), ("ver20990101x",)], "name string")
    return o.union(odd).agg(F.max(R.latest_version(F.col("name"))).alias("version"))


# Sinks that write.
@query("sink_pg_upsert", with_ctes("facilities", "SELECT id, CASE WHEN id % 4 = 0 THEN 'clinic' ELSE type END AS type FROM facilities"))
def sink_pg_upsert(spark, d):
    base = written(facilities(spark, d).select("id", "type"))
    return written(S.upsert(base, base.filter("id % 4 = 0").withColumn("type", F.lit("clinic")), ["id"]))


@query("sink_batch", with_ctes("facilities", "SELECT id, CASE WHEN id % 4 = 0 THEN 'second' WHEN id % 2 = 0 THEN 'first' ELSE type END AS type FROM facilities"))
def sink_batch(spark, d):
    base = written(facilities(spark, d).select("id", "type"))
    first = base.filter("id % 2 = 0").select("id", F.lit("first").alias("type"), F.col("id").alias("seq"))
    second = base.filter("id % 4 = 0").select("id", F.lit("second").alias("type"), (F.col("id") + 1_000_000_000_000).alias("seq"))
    return written(S.upsert_batches(base, first.union(second), ["id"], 500))


META = [("제목", 'Units, "ranked"'), ("기준월", "2001-07"), ("데이터모드", "live"), ("출처", "driver tables"), ("내보낸시각", "2001-08-01T00:00:00Z")]
_META_SQL = "VALUES ('제목,\"Units, \"\"ranked\"\"\"'), ('기준월,2001-07'), ('데이터모드,live'), ('출처,driver tables'), ('내보낸시각,2001-08-01T00:00:00Z'), ('')"


def _lines_back(spark, lines):
    """Lines as written; the reader takes the byte order mark away."""
    path = shared_path(spark, "csv")
    S.write_lines(lines, path)
    return spark.read.option("lineSep", "\r\n").text(path)


@query("sink_csv_rank", with_ctes("cells", f"SELECT col0 AS value FROM ({_META_SQL}) t UNION ALL SELECT '순위,행정동코드,시도시,이름,값,비고' UNION ALL SELECT (ordinal + 1) || ',' || code || ',' || sgg || ',' || name || ',\"1,' || ordinal || '\",' FROM cells"))
def sink_csv_rank(spark, d):
    rows = cells(spark, d).select((F.col("ordinal") + 1).alias("rank_"), (F.col("ordinal") + 1).alias("rank"), "code", "sgg", "name", F.concat(F.lit("1,"), F.col("ordinal")).alias("v"), F.lit(None).cast("string").alias("note"))
    return _lines_back(spark, S.csv_lines(rows, ["순위", "행정동코드", "시도시", "이름", "값", "비고"], "rank_", META))


@query("sink_csv_fac", with_ctes("facilities", f"SELECT col0 AS value FROM ({_META_SQL}) t UNION ALL SELECT 'ID,시설명,유형,시도시,행정동,주소' UNION ALL SELECT id || ',' || name || ',' || type || ',,' || code || ',\"no \"\"' || id || '\"\"\"' FROM facilities"))
def sink_csv_fac(spark, d):
    rows = facilities(spark, d).select((F.col("id") + 1).alias("n_"), "id", "name", "type", F.lit("").alias("sido"), "code", F.concat(F.lit('no "'), F.col("id"), F.lit('"')).alias("address"))
    return _lines_back(spark, S.csv_lines(rows, ["ID", "시설명", "유형", "시도시", "행정동", "주소"], "n_", META))


@query("sink_csv_core", with_ctes("facilities", "SELECT 'id,\"a,b\"' AS value UNION ALL SELECT id || ',' || CASE WHEN id % 2 = 0 THEN '\"x,' || id || '\"' ELSE 'x' END FROM facilities"))
def sink_csv_core(spark, d):
    rows = facilities(spark, d).select((F.col("id") + 1).alias("n_"), "id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("x,"), F.col("id"))).otherwise("x").alias("a"))
    return _lines_back(spark, S.csv_lines(rows, ["id", "a,b"], "n_"))
