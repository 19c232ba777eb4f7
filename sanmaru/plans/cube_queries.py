"""Queries on the monthly cube: roll-ups, rankings, statistics, crosses and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from sanmaru.functions.numeric import half_up
from sanmaru.operators import cube as C
from sanmaru.plans.registry import query
from sanmaru.sources.bindings import cells, monthly_cube, with_ctes

#: Reference month: 2001-07.
REF = 2001 * 12 + 6
R = "floor({0} * 1e6 + 0.5) / 1e6"


def r6(column, name=None):
    out = half_up(F.col(column) if isinstance(column, str) else column, 6)
    return out.alias(name or column)


def sql6(expression: str, name: str) -> str:
    return f"floor(({expression}) * 1e6 + 0.5) / 1e6 AS {name}"


def now(spark, d):
    return C.at_month(monthly_cube(spark, d), REF)


NOW = "WITH now AS (SELECT * FROM cube WHERE month_no = 24018)"


@query("layer_view", with_ctes("cells cube", f"SELECT code, name, {sql6('rev', 'value')}, row_number() OVER (ORDER BY rev DESC NULLS LAST, ordinal)::INT AS rank FROM cells LEFT JOIN (SELECT * FROM cube WHERE month_no = 24018) USING (code)"))
def layer_view(spark, d):
    """Value of each cell at the reference month, ranked."""
    rows = cells(spark, d).join(now(spark, d), "code", "left")
    return C.rank_rows(rows, "rev", tie="ordinal").select("code", "name", r6("rev", "value"), "rank")


@query("win_layer_rank", with_ctes("cells cube", f"SELECT code, {sql6('ratio', 'value')}, row_number() OVER (ORDER BY ratio ASC NULLS LAST, ordinal)::INT AS rank FROM cells LEFT JOIN (SELECT * FROM cube WHERE month_no = 24010) USING (code)"))
def win_layer_rank(spark, d):
    rows = cells(spark, d).join(C.at_month(monthly_cube(spark, d), 24010), "code", "left")
    return C.rank_rows(rows, "ratio", descending=False, tie="ordinal").select("code", r6("ratio", "value"), "rank")


@query("agg_sgg_sum", with_ctes("cube", f"SELECT substr(code, 1, 5) AS code, month_no, {sql6('sum(coalesce(rev, 0))', 'rev')}, sum(n)::BIGINT AS n FROM cube GROUP BY 1, 2"))
def agg_sgg_sum(spark, d):
    return C.roll_up(monthly_cube(spark, d), ["rev", "n"], {}).select("code", "month_no", r6("rev"), "n")


@query("agg_sgg_wavg", with_ctes("cube", f"SELECT substr(code, 1, 5) AS code, month_no, {sql6('sum(ratio * n) / nullif(sum(n) FILTER (ratio IS NOT NULL), 0)', 'ratio')} FROM cube GROUP BY 1, 2"))
def agg_sgg_wavg(spark, d):
    return C.roll_up(monthly_cube(spark, d), [], {"ratio": "n"}).select("code", "month_no", r6("ratio"))


@query("agg_sgg_geom", with_ctes("cells", f"SELECT substr(code, 1, 5) AS code, min_by(array_to_string(string_split(name, ' ')[1:2], ' '), ordinal) AS name, sum(area_km2) AS area_km2, {sql6('avg(lat)', 'lat')}, {sql6('avg(lng)', 'lng')}, count(*) AS members FROM cells GROUP BY 1"))
def agg_sgg_geom(spark, d):
    return C.roll_up_cells(cells(spark, d)).select("code", "name", "area_km2", r6("lat"), r6("lng"), "members")


@query("join_sgg_broadcast", with_ctes("cells cube", f"WITH p AS (SELECT substr(code, 1, 5) AS sgg, sum(rev) AS v FROM cube WHERE month_no = 24018 GROUP BY 1) SELECT code, {sql6('v', 'value')} FROM cells JOIN p USING (sgg)"))
def join_sgg_broadcast(spark, d):
    """A district's value on each of its cells."""
    parents = C.roll_up(now(spark, d), ["rev"], {}).select(F.col("code").alias("sgg"), "rev")
    return cells(spark, d).join(parents, "sgg").select("code", r6("rev", "value"))


@query("win_zscore", with_ctes("cube", NOW + f" SELECT code, {sql6('(rev - avg(rev) OVER ()) / coalesce(nullif(stddev_pop(rev) OVER (), 0), 1)', 'z')} FROM now"))
def win_zscore(spark, d):
    return C.z_scores(now(spark, d), ("rev", "z")).select("code", r6("z"))


@query("win_zscore_multi", with_ctes("cube", f"SELECT code, month_no, {sql6('(qty - avg(qty) OVER w) / coalesce(nullif(stddev_pop(qty) OVER w, 0), 1)', 'z')} FROM cube WINDOW w AS (PARTITION BY month_no)"))
def win_zscore_multi(spark, d):
    cube = monthly_cube(spark, d)
    stats = cube.groupBy("month_no").agg(F.avg("qty").alias("m"), F.stddev_pop("qty").alias("s"))
    return cube.join(stats, "month_no").select("code", "month_no", r6((F.col("qty") - F.col("m")) / F.coalesce(F.nullif(F.col("s"), F.lit(0.0)), F.lit(1.0)), "z"))


@query("win_minmax_score", with_ctes("cube", NOW + f" SELECT code, {sql6('CASE WHEN count(*) OVER () = 1 THEN 50 ELSE (rev - min(rev) OVER ()) / greatest(1e-9, max(rev) OVER () - min(rev) OVER ()) * 100 END', 'score')} FROM now"))
def win_minmax_score(spark, d):
    return C.min_max_scores(now(spark, d), "rev").select("code", r6("score"))


@query("win_minmax_layer", with_ctes("cube", NOW + f" SELECT code, {sql6('(ratio - min(ratio) OVER ()) / greatest(1, max(ratio) OVER () - min(ratio) OVER ()) * 100', 'score')} FROM now"))
def win_minmax_layer(spark, d):
    return C.min_max_scores(now(spark, d), "ratio", least_span=1.0, single=None).select("code", r6("score"))


_WINSOR = "WITH p AS (SELECT quantile_cont(rev, 0.05) AS lo, quantile_cont(rev, 0.95) AS hi FROM cube WHERE month_no = 24018) SELECT code, {0} FROM cube, p WHERE month_no = 24018"


@query("win_winsor", with_ctes("cube", _WINSOR.format(sql6("CASE WHEN hi = lo THEN 0 ELSE (greatest(lo, least(hi, rev)) - lo) / (hi - lo) * 100 END", "score") + ", " + sql6("CASE WHEN hi = lo THEN 0 ELSE 100 - (greatest(lo, least(hi, rev)) - lo) / (hi - lo) * 100 END", "inverted"))))
def win_winsor(spark, d):
    rows = C.winsor_scores(now(spark, d), ("rev", "score", False), ("rev", "inverted", True))
    return rows.select("code", r6("score"), r6("inverted"))


@query("win_percentile", with_ctes("cube", f"SELECT month_no, {sql6('quantile_cont(rev, 0.05)', 'p05')}, {sql6('quantile_cont(rev, 0.5)', 'p50')}, {sql6('quantile_cont(rev, 0.95)', 'p95')} FROM cube GROUP BY 1"))
def win_percentile(spark, d):
    return monthly_cube(spark, d).groupBy("month_no").agg(*[r6(F.percentile("rev", F.lit(p)), n) for p, n in ((0.05, "p05"), (0.5, "p50"), (0.95, "p95"))])


@query("win_quantile_breaks", with_ctes("cube", f"SELECT {', '.join(sql6(f'quantile_cont(rev, {i / 5})', f'b{i}') for i in range(1, 5))} FROM cube WHERE month_no = 24018"))
def win_quantile_breaks(spark, d):
    cuts = F.percentile("rev", F.array(*[F.lit(i / 5) for i in range(1, 5)]))
    return now(spark, d).agg(cuts.alias("b")).select(*[r6(F.col("b")[i - 1], f"b{i}") for i in range(1, 5)])


@query("win_color_bin", with_ctes("cube", "WITH b AS (SELECT [quantile_cont(rev, 0.2), quantile_cont(rev, 0.4), quantile_cont(rev, 0.6), quantile_cont(rev, 0.8)] AS b FROM cube WHERE month_no = 24018) SELECT code, len(list_filter(b, lambda x: x < rev))::INT AS bin FROM cube, b WHERE month_no = 24018"))
def win_color_bin(spark, d):
    return C.color_bins(now(spark, d), "rev").select("code", "bin")


@query("win_percentile_rank", with_ctes("cube", f"SELECT code, month_no, {sql6('(count(*) OVER (PARTITION BY month_no ORDER BY n) - 1) / nullif(count(*) OVER (PARTITION BY month_no) - 1, 0)::DOUBLE * 100', 'percentile')} FROM cube"))
def win_percentile_rank(spark, d):
    return C.percentile_ranks(monthly_cube(spark, d), "n", ["month_no"]).select("code", "month_no", r6("percentile"))


def _pair(spark, d):
    c = now(spark, d)
    return c.select("code", F.col("rev").alias("a")), c.select("code", F.col("ratio").alias("b"))


_Z = "(({v}) - avg({v}) OVER ()) / coalesce(nullif(stddev_pop({v}) OVER (), 0), 1)"
_CROSS = (
    NOW + ", z AS (SELECT code, " + _Z.format(v="rev") + " AS za, " + _Z.format(v="ratio") + " AS zb FROM now), c AS (SELECT *, za {sign} zb AS combined FROM z) SELECT code, " + sql6("za", "za") + ", " + sql6("zb", "zb") + ", " + sql6("combined", "combined")
    + ", " + sql6("(combined - min(combined) OVER ()) / greatest(1e-9, max(combined) OVER () - min(combined) OVER ()) * 100", "score") + " FROM c"
)


def _cross(spark, d, sign):
    return C.cross(*_pair(spark, d), sign).select("code", r6("za"), r6("zb"), r6("combined"), r6("score"))


@query("cross_gap", with_ctes("cube", _CROSS.format(sign="-")))
def cross_gap(spark, d):
    return _cross(spark, d, -1)


@query("cross_both", with_ctes("cube", _CROSS.format(sign="+")))
def cross_both(spark, d):
    return _cross(spark, d, 1)


@query("join_metric_inner", with_ctes("cube", f"SELECT code, a.month_no, {sql6('a.rev', 'a')}, {sql6('b.ratio', 'b')} FROM cube a JOIN cube b USING (code) WHERE a.month_no = 24010 AND b.month_no = 24018 AND a.rev IS NOT NULL AND b.ratio IS NOT NULL"))
def join_metric_inner(spark, d):
    cube = monthly_cube(spark, d)
    a, b = C.at_month(cube, 24010).select("code", "month_no", F.col("rev").alias("a")), C.at_month(cube, REF).select("code", F.col("ratio").alias("b"))
    return a.join(b, "code").filter("a is not null and b is not null").select("code", "month_no", r6("a"), r6("b"))


@query("multi", with_ctes("cube", NOW + f", z AS (SELECT code, {_Z.format(v='rev')} - {_Z.format(v='ratio')} + {_Z.format(v='qty')} AS combined FROM now) SELECT code, {sql6('combined', 'combined')}, {sql6('(combined - min(combined) OVER ()) / greatest(1e-9, max(combined) OVER () - min(combined) OVER ()) * 100', 'score')} FROM z"))
def multi(spark, d):
    c = now(spark, d)
    view = lambda m: c.select("code", F.col(m).alias("value"))
    return C.multi([(view("rev"), 1), (view("ratio"), -1), (view("qty"), 1)]).select("code", r6("combined"), r6("score"))


@query("join_metric_nway", with_ctes("cube", "WITH k AS (SELECT code, count(DISTINCT month_no) AS m FROM cube WHERE month_no IN (24000, 24010, 24018) GROUP BY 1) SELECT count(*) FILTER (m = 3) AS comparable, count(*) AS total FROM k"))
def join_metric_nway(spark, d):
    codes = [C.at_month(monthly_cube(spark, d), m).select("code") for m in (24000, 24010, REF)]
    total = codes[0].union(codes[1]).union(codes[2]).distinct()
    both = codes[0].join(codes[1], "code").join(codes[2], "code").withColumn("in_all", F.lit(True))
    return total.join(both, "code", "left").agg(F.count_if("in_all").alias("comparable"), F.count(F.lit(1)).alias("total"))


_TREND = (
    "WITH w AS (SELECT *, (month_no - min(month_no) OVER ())::DOUBLE AS idx FROM cube WHERE month_no >= 24007), t AS (SELECT code, count({m}) AS points, min_by({m}, idx) AS first, max_by({m}, idx) AS last, regr_slope({m}, idx) AS slope FROM w GROUP BY code), "
    "c AS (SELECT *, CASE WHEN first <> 0 THEN (last - first) / abs(first) * 100 END AS change FROM t)"
)


def _last_year(spark, d):
    return monthly_cube(spark, d).filter(F.col("month_no").between(0, REF))


_TREND_CUBE = _TREND.replace("FROM cube WHERE month_no >= 24007", "FROM cube WHERE month_no BETWEEN 24007 AND 24018")


@query("win_trend", with_ctes("cube", _TREND_CUBE.format(m="rev") + f" SELECT code, points, {sql6('first', 'first')}, {sql6('last', 'last')}, {sql6('change', 'change')}, {sql6('slope', 'slope')}, CASE WHEN change > 3 THEN 'rising' WHEN change < -3 THEN 'falling' ELSE 'flat' END AS direction FROM c"))
def win_trend(spark, d):
    return C.trends(_last_year(spark, d), "rev", 12).select("code", "points", r6("first"), r6("last"), r6("change"), r6("slope"), "direction")


@query("trend_rank", with_ctes("cube", _TREND_CUBE.format(m="rev") + f" SELECT code, {sql6('change', 'change')}, {sql6('(change - min(change) OVER ()) / greatest(1e-9, max(change) OVER () - min(change) OVER ()) * 100', 'score')}, row_number() OVER (ORDER BY change DESC, code)::INT AS rank FROM c WHERE change IS NOT NULL"))
def trend_rank(spark, d):
    return C.trend_ranking(_last_year(spark, d), "rev", 12).select("code", r6("change"), r6("score"), "rank")


@query("win_small_base", with_ctes("cube", _TREND_CUBE.format(m="rev") + f", r AS (SELECT *, row_number() OVER (ORDER BY change DESC, code) AS rank FROM c WHERE change IS NOT NULL), q AS (SELECT list_sort(list(first))[(floor(count(*) * 0.25) + 1)::INT] AS threshold, count(*) AS rows FROM r) SELECT {sql6('threshold', 'threshold')}, rows, count(*) FILTER (rank <= 10 AND first < threshold) AS small FROM r, q GROUP BY q.threshold, rows"))
def win_small_base(spark, d):
    return C.small_base(C.trend_ranking(_last_year(spark, d), "rev", 12)).select(r6("threshold"), "rows", "small")


@query("trend_cross", with_ctes("cube", _TREND_CUBE.format(m="rev").replace(" t AS", " t AS").replace("c AS", "ca AS") + ", tb AS (SELECT code, min_by(ratio, idx) AS first, max_by(ratio, idx) AS last FROM w GROUP BY code), cb AS (SELECT code, CASE WHEN first <> 0 THEN (last - first) / abs(first) * 100 END AS b FROM tb), j AS (SELECT code, change AS a, b FROM ca JOIN cb USING (code) WHERE change IS NOT NULL AND b IS NOT NULL), z AS (SELECT *, "
    + _Z.format(v="a") + " - (" + _Z.format(v="b") + f") AS combined FROM j) SELECT code, {sql6('combined', 'combined')}, {sql6('(combined - min(combined) OVER ()) / greatest(1e-9, max(combined) OVER () - min(combined) OVER ()) * 100', 'score')}, a > 0 AND -b > 0 AS matches FROM z"))
def trend_cross(spark, d):
    rates = lambda m, n: C.trends(_last_year(spark, d), m, 12).select("code", F.col("change").alias(n))
    return C.trend_cross(rates("rev", "a"), rates("ratio", "b"), 1, -1).select("code", r6("combined"), r6("score"), "matches")


@query("join_trend_inner", with_ctes("cells cube", _TREND_CUBE.format(m="qty") + f" SELECT code, name, {sql6('change', 'change')} FROM c JOIN cells USING (code) WHERE contains(replace(name, ' ', ''), 'ASIA')"))
def join_trend_inner(spark, d):
    named = cells(spark, d).filter(F.regexp_replace("name", " ", "").contains("ASIA"))
    return C.trends(_last_year(spark, d), "qty", 12).join(named, "code").select("code", "name", r6("change"))


@query("win_recent_months", with_ctes("cube", "SELECT code, count(*) AS months, min(month_no)::INT AS first_month FROM cube WHERE month_no >= (SELECT max(month_no) FROM cube) - 5 GROUP BY 1"))
def win_recent_months(spark, d):
    return C.recent(monthly_cube(spark, d), 6).groupBy("code").agg(F.count(F.lit(1)).alias("months"), F.min("month_no").alias("first_month"))


@query("win_recent_n", with_ctes("cube", f"SELECT code, month_no, {sql6('rev', 'rev')} FROM cube QUALIFY row_number() OVER (PARTITION BY code ORDER BY month_no DESC) <= 3"))
def win_recent_n(spark, d):
    from pyspark.sql import Window as W

    rows = monthly_cube(spark, d).withColumn("k", F.row_number().over(W.partitionBy("code").orderBy(F.desc("month_no"))))
    return rows.filter("k <= 3").select("code", "month_no", r6("rev"))


@query("region_profile", with_ctes("cube", "WITH l AS (SELECT code, month_no, 'rev' AS metric, rev AS value FROM cube UNION ALL SELECT code, month_no, 'qty', qty FROM cube UNION ALL SELECT code, month_no, 'ratio', ratio FROM cube), p AS (SELECT *, (count(*) OVER (PARTITION BY metric ORDER BY value) - 1) / nullif(count(*) OVER (PARTITION BY metric) - 1, 0)::DOUBLE * 100 AS percentile FROM l WHERE month_no = 24018), "
    f"t AS (SELECT metric, min_by(value, month_no) AS f, max_by(value, month_no) AS e FROM l WHERE code = '0000000000' GROUP BY 1) SELECT metric, {sql6('value', 'value')}, {sql6('percentile', 'percentile')}, {sql6('(e - f) / abs(f) * 100', 'change')}, CASE WHEN (e - f) / abs(f) * 100 > 3 THEN 'rising' WHEN (e - f) / abs(f) * 100 < -3 THEN 'falling' ELSE 'flat' END AS direction FROM p JOIN t USING (metric) WHERE code = '0000000000'"))  # fmt: skip
def region_profile(spark, d):
    return C.profile(monthly_cube(spark, d), ["rev", "qty", "ratio"], "0000000000", REF).select("metric", r6("value"), r6("percentile"), r6("change"), "direction")


@query("layer_analysis", with_ctes("cells cube", f"WITH j AS (SELECT code, name, rev FROM cells LEFT JOIN (SELECT * FROM cube WHERE month_no = 24018) USING (code)) SELECT code, name, {sql6('(rev - min(rev) OVER ()) / greatest(1, max(rev) OVER () - min(rev) OVER ()) * 100', 'score')}, {sql6('rev', 'value')} FROM j"))
def layer_analysis(spark, d):
    rows = cells(spark, d).join(now(spark, d), "code", "left")
    return C.min_max_scores(rows, "rev", least_span=1.0, single=None).select("code", "name", r6("score"), r6("rev", "value"))


@query("win_first_last_month", with_ctes("cube", "SELECT code, month_no FROM cube WHERE month_no = coalesce((SELECT max(month_no) FROM cube WHERE month_no = 99999), (SELECT max(month_no) FROM cube))"))
def win_first_last_month(spark, d):
    return C.reference_month(monthly_cube(spark, d), 99999).select("code", "month_no")


@query("topk_default", with_ctes("cube", NOW + f" SELECT code, {sql6('rev', 'rev')}, row_number() OVER (ORDER BY rev DESC, code)::INT AS rank FROM now ORDER BY rev DESC, code LIMIT 10"))
def topk_default(spark, d):
    return C.rank_rows(now(spark, d), "rev", limit=10).select("code", r6("rev"), "rank")


@query("topk_percent", with_ctes("cube", NOW + " SELECT code, row_number() OVER (ORDER BY rev DESC, code)::INT AS rank FROM now QUALIFY rank <= greatest(1, ceil(count(*) OVER () * 0.3))"))
def topk_percent(spark, d):
    return C.top_percent(C.rank_rows(now(spark, d), "rev"), 30).select("code", "rank")


@query("topk_cross_30", with_ctes("cube", NOW + f", z AS (SELECT code, {_Z.format(v='rev')} - {_Z.format(v='ratio')} AS combined FROM now) SELECT code, {sql6('combined', 'combined')}, count(*) OVER () AS total_count FROM z ORDER BY combined DESC, code LIMIT 30"))
def topk_cross_30(spark, d):
    rows = C.with_stats(C.cross(*_pair(spark, d), -1), total_count=F.count(F.lit(1)))
    return rows.orderBy(F.desc("combined"), "code").limit(30).select("code", r6("combined"), "total_count")


@query("flt_threshold", with_ctes("cube", f"SELECT code, month_no, {sql6('ratio', 'ratio')} FROM cube WHERE ratio >= 37000"))
def flt_threshold(spark, d):
    return C.threshold(monthly_cube(spark, d), "ratio", ">=", 37000).select("code", "month_no", r6("ratio"))


@query("set_union_months", with_ctes("cube", "SELECT month_no FROM cube WHERE code = '0000000000' UNION SELECT month_no FROM cube WHERE code = '0000100001'"))
def set_union_months(spark, d):
    months = lambda c: monthly_cube(spark, d).filter(F.col("code") == c).select("month_no")
    return months("0000000000").union(months("0000100001")).distinct()


@query("set_intersect_months", with_ctes("cube", "SELECT month_no FROM cube WHERE code = '0000000000' INTERSECT SELECT month_no FROM cube WHERE code = '0000100001'"))
def set_intersect_months(spark, d):
    months = lambda c: monthly_cube(spark, d).filter(F.col("code") == c).select("month_no")
    return months("0000000000").intersect(months("0000100001"))


@query("join_month_common", with_ctes("cube", "WITH k AS (SELECT month_no FROM cube GROUP BY 1 HAVING count(DISTINCT code) = (SELECT count(DISTINCT code) FROM cube)) SELECT max(month_no)::INT AS month_no, count(*) AS common FROM k"))
def join_month_common(spark, d):
    """The latest of the months that all cells share."""
    cube = monthly_cube(spark, d)
    per = cube.groupBy("month_no").agg(F.count_distinct("code").alias("k"))
    every = F.broadcast(cube.agg(F.count_distinct("code").alias("all")))
    return per.join(every, F.col("k") == F.col("all")).agg(F.max("month_no").alias("month_no"), F.count(F.lit(1)).alias("common"))


@query("set_intersect_codes", with_ctes("cube", "SELECT code FROM cube WHERE month_no = 24000 INTERSECT SELECT code FROM cube WHERE month_no = 24018"))
def set_intersect_codes(spark, d):
    cube = monthly_cube(spark, d)
    return C.at_month(cube, 24000).select("code").intersect(C.at_month(cube, REF).select("code"))


@query("set_union_codes", with_ctes("cube", "SELECT code FROM cube WHERE month_no = 24000 UNION SELECT code FROM cube WHERE month_no = 24018"))
def set_union_codes(spark, d):
    cube = monthly_cube(spark, d)
    return C.at_month(cube, 24000).select("code").union(C.at_month(cube, REF).select("code")).distinct()


@query("set_diff_missing", with_ctes("cells cube", "WITH m AS (SELECT DISTINCT month_no FROM cube) SELECT code, month_no FROM cells, m EXCEPT SELECT code, month_no FROM cube"))
def set_diff_missing(spark, d):
    """Cell months without a value; cells and months are both few at any scale."""
    cube = monthly_cube(spark, d)
    grid = cells(spark, d).select("code").crossJoin(F.broadcast(cube.select("month_no").distinct()))
    return grid.join(cube.select("code", "month_no"), ["code", "month_no"], "left_anti")


@query("set_diff_unmatched", with_ctes("cells cube", "SELECT DISTINCT code FROM cube WHERE code NOT IN (SELECT code FROM cells WHERE ordinal < 20)"))
def set_diff_unmatched(spark, d):
    return monthly_cube(spark, d).select("code").distinct().join(cells(spark, d).filter("ordinal < 20"), "code", "left_anti")


@query("join_boundary_left", with_ctes("cells cube", f"SELECT code, name, {sql6('rev', 'rev')} FROM cells LEFT JOIN (SELECT * FROM cube WHERE month_no = 24005) USING (code)"))
def join_boundary_left(spark, d):
    return cells(spark, d).join(C.at_month(monthly_cube(spark, d), 24005), "code", "left").select("code", "name", r6("rev"))


@query("win_consecutive", with_ctes("cube", "WITH g AS (SELECT code, month_no - lag(month_no) OVER (PARTITION BY code ORDER BY month_no) AS gap FROM cube) SELECT code, count(*) FILTER (gap > 1) AS gaps, coalesce(max(gap), 0)::INT AS widest FROM g GROUP BY 1"))
def win_consecutive(spark, d):
    from pyspark.sql import Window as W

    gap = F.col("month_no") - F.lag("month_no").over(W.partitionBy("code").orderBy("month_no"))
    return monthly_cube(spark, d).withColumn("gap", gap).groupBy("code").agg(F.count_if(F.col("gap") > 1).alias("gaps"), F.coalesce(F.max("gap"), F.lit(0)).alias("widest"))


@query("agg_months_in", with_ctes("cube", "SELECT DISTINCT month_no FROM cube"))
def agg_months_in(spark, d):
    return monthly_cube(spark, d).select("month_no").distinct()


@query("fn_unit_label", with_ctes("cells", "SELECT CASE WHEN bool_and(length(code) = 10) THEN 'dong' WHEN bool_and(length(code) = 5) THEN 'district' ELSE 'grid' END AS unit FROM cells"))
def fn_unit_label(spark, d):
    from sanmaru.functions.codes import unit_label

    return cells(spark, d).agg(unit_label(F.bool_and(F.length("code") == 10), F.bool_and(F.length("code") == 5)).alias("unit"))


@query("fn_standing", with_ctes("cube", NOW + f", z AS (SELECT code, {_Z.format(v='rev')} AS z FROM now) SELECT code, CASE WHEN z >= 1.5 THEN 'very high' WHEN z >= 0.5 THEN 'high' WHEN z > -0.5 THEN 'average' WHEN z > -1.5 THEN 'low' ELSE 'very low' END AS standing FROM z"))
def fn_standing(spark, d):
    from sanmaru.functions.numeric import standing

    return C.z_scores(now(spark, d), ("rev", "z")).select("code", standing(F.col("z")).alias("standing"))
