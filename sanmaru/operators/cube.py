"""Cube operators on long tables ``(code, month_no, <metrics>)``: ranking, roll-up, crosses, trends, profiles.

Statistics over all rows are one-row aggregates that are joined back, so no operator pulls its rows into one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sanmaru.functions.codes import parent_code, parent_name
from sanmaru.functions.numeric import sum_as_zero, weighted_mean
from sanmaru.session import written


def with_stats(df: DataFrame, **stats: Column) -> DataFrame:
    """``df`` with aggregates over all of its rows: one row, broadcast."""
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(n) for n, c in stats.items()])))


def at_month(cube: DataFrame, month_no: int) -> DataFrame:
    return cube.filter(F.col("month_no") == month_no)


def reference_month(cube: DataFrame, wanted: int | None = None) -> DataFrame:
    """Rows of the wanted month, or of the last one if the cube lacks it."""
    last = cube.agg(F.coalesce(F.max(F.when(F.col("month_no") == wanted, wanted)) if wanted is not None else F.lit(None), F.max("month_no")).alias("month_no"))
    return cube.join(F.broadcast(last), "month_no")


def rank_rows(df: DataFrame, value: str, descending: bool = True, tie: str = "code", limit: int | None = None, keep_null: bool = True) -> DataFrame:
    """Rank 1..n by value, nulls last, ties by ``tie``. A limit is pushed below the ranking as a top-k."""
    order = [F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last(), F.col(tie)]
    rows = df if keep_null else df.filter(F.col(value).isNotNull())
    rows = rows.orderBy(*order).limit(limit) if limit else rows
    return rows.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def roll_up(cube: DataFrame, sums: list[str], means: dict[str, str | None]) -> DataFrame:
    """Cells to districts: sums take null as 0; means are weighted by another metric (or by 1)."""
    parts = [sum_as_zero(F.col(m)).alias(m) for m in sums]
    parts += [weighted_mean(F.col(m), F.col(w) if w else F.lit(1.0)).alias(m) for m, w in means.items()]
    return cube.groupBy(parent_code(F.col("code")).alias("code"), "month_no").agg(*parts)


def roll_up_cells(cells: DataFrame) -> DataFrame:
    """Districts of cells: area summed, points averaged, name of the first member."""
    return cells.groupBy(parent_code(F.col("code")).alias("code")).agg(F.min_by(parent_name(F.col("name")), "ordinal").alias("name"), F.sum("area_km2").alias("area_km2"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.count(F.lit(1)).alias("members"))


def z_scores(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Population z-scores of each ``(value, out)`` in one pass; a spread of 0 counts as 1."""
    stats = {k: v for value, out in pairs for k, v in ((f"mean_{out}", F.avg(value)), (f"sd_{out}", F.stddev_pop(value)))}
    rows = with_stats(df, **stats)
    scores = {out: (F.col(value) - F.col(f"mean_{out}")) / F.coalesce(F.nullif(F.col(f"sd_{out}"), F.lit(0.0)), F.lit(1.0)) for value, out in pairs}
    return rows.withColumns(scores).drop(*stats)


def min_max_scores(df: DataFrame, value: str, out: str = "score", least_span: float = 1e-9, single: float | None = 50.0) -> DataFrame:
    """0-100 between the extremes; one row alone scores ``single``."""
    rows = with_stats(df, lo_=F.min(value), hi_=F.max(value), n_=F.count(value))
    score = (F.col(value) - F.col("lo_")) / F.greatest(F.lit(least_span), F.col("hi_") - F.col("lo_")) * 100
    return rows.withColumn(out, F.when(F.col("n_") == 1, F.lit(single)).otherwise(score) if single is not None else score).drop("lo_", "hi_", "n_")


def winsor_scores(df: DataFrame, *columns: tuple[str, str, bool], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """For each ``(value, out, inverted)``, in one pass: clamp to two interpolated percentiles, then 0-100.

    A span of 0 scores 0 in either direction; null stays null.
    """
    stats = {f"p_{out}": F.percentile(value, F.array(F.lit(low), F.lit(high))) for value, out, _ in columns}
    rows, scores = with_stats(df, **stats), {}
    for value, out, inverted in columns:
        lo, hi = F.col(f"p_{out}")[0], F.col(f"p_{out}")[1]
        share = (F.greatest(lo, F.least(hi, F.col(value))) - lo) / F.nullif(hi - lo, F.lit(0.0)) * 100
        scores[out] = F.when(F.col(value).isNull(), None).when(hi == lo, 0.0).otherwise((100 - share) if inverted else share)
    return rows.withColumns(scores).drop(*stats)


def color_bins(df: DataFrame, value: str, bins: int = 5) -> DataFrame:
    """``bin``: how many of the interpolated quantile breaks lie below the value; null has no bin."""
    cuts = F.percentile(value, F.array(*[F.lit(i / bins) for i in range(1, bins)]))
    return with_stats(df, breaks=cuts).withColumn("bin", F.when(F.col(value).isNotNull(), F.size(F.filter("breaks", lambda b: b < F.col(value)))))


def percentile_ranks(df: DataFrame, value: str, by: list[str], out: str = "percentile") -> DataFrame:
    """(rows at or below - 1) / (n - 1) * 100 inside groups; ties take the upper rank, a single row has none.

    Equal values are counted first, so windows only order distinct values. Rows are written once, since both sides of the
    join must hold the same values: sums of floats that are worked out twice can differ.
    """
    df = written(df)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("k_"))
    below = F.sum("k_").over(W.partitionBy(*by).orderBy(value))
    n = F.sum("k_").over(W.partitionBy(*by))
    ranks = counts.withColumn(out, F.when(n > 1, (below - 1) / (n - 1) * 100)).drop("k_")
    return df.join(ranks, [*by, value], "left")


def cross(a: DataFrame, b: DataFrame, sign: int) -> DataFrame:
    """``a(code, a)`` with ``b(code, b)``: the sum or difference of their z-scores, and 0-100 scores of it.

    Only codes with both values count, and the z-scores are theirs.
    """
    both = a.join(b, "code").filter("a is not null and b is not null")
    scored = z_scores(both, ("a", "za"), ("b", "zb")).withColumn("combined", F.col("za") + sign * F.col("zb"))
    return min_max_scores(scored, "combined")


def multi(operands: list[tuple[DataFrame, int]]) -> DataFrame:
    """Signed z-scores of three or more ``(code, value)`` tables, summed over the codes that all have."""
    joined = reduce(lambda x, y: x.join(y, "code"), [d.filter("value is not null").withColumnRenamed("value", f"v{i}") for i, (d, _) in enumerate(operands)])
    joined = z_scores(joined, *[(f"v{i}", f"z{i}") for i in range(len(operands))])
    combined = reduce(lambda x, y: x + y, [s * F.col(f"z{i}") for i, (_, s) in enumerate(operands)])
    return min_max_scores(joined.withColumn("combined", combined), "combined")


def recent(cube: DataFrame, months: int | None) -> DataFrame:
    """The last calendar months of the cube, not of its observations."""
    if months is None:
        return cube
    return with_stats(cube, last_=F.max("month_no")).filter(F.col("month_no") >= F.col("last_") - (months - 1)).drop("last_")


def trends(cube: DataFrame, value: str, months: int | None = None, flat: float = 3.0) -> DataFrame:
    """``code, points, first, last, change, slope, direction`` over known values; the index is the place in the window.

    ``change`` is the percentage over the absolute first value, null if that is 0; ``direction`` is flat inside the band.
    """
    rows = with_stats(recent(cube, months), start_=F.min("month_no")).withColumn("at", (F.col("month_no") - F.col("start_")).cast("double"))
    known = rows.filter(F.col(value).isNotNull())
    out = known.groupBy("code").agg(F.count(F.lit(1)).alias("points"), F.min_by(value, "at").alias("first"), F.max_by(value, "at").alias("last"), F.regr_slope(value, "at").alias("slope"))
    change = F.when(F.col("first") != 0, (F.col("last") - F.col("first")) / F.abs("first") * 100)
    by_sign = F.when(F.col("last") > F.col("first"), "rising").when(F.col("last") < F.col("first"), "falling").otherwise("flat")
    out = out.withColumn("change", change)
    return out.withColumn("direction", F.when(F.col("points") < 2, None).when(F.col("change").isNull(), by_sign).when(F.col("change") > flat, "rising").when(F.col("change") < -flat, "falling").otherwise("flat"))


def trend_ranking(cube: DataFrame, value: str, months: int | None = None, descending: bool = True) -> DataFrame:
    """Codes by change rate, those without one dropped, with 0-100 scores in the ranking's direction."""
    rows = trends(cube, value, months).filter("change is not null")
    scored = min_max_scores(rows.withColumn("signed", F.col("change") if descending else -F.col("change")), "signed").drop("signed")
    return rank_rows(scored, "change", descending)


def small_base(ranked: DataFrame, top: int = 10, least: int = 8) -> DataFrame:
    """One row: the lower quartile of first values (if there are ``least`` rows) and how many of the top rows lie below."""
    quartile = F.element_at(F.array_sort(F.collect_list("first")), (F.floor(F.count(F.lit(1)) * 0.25) + 1).cast("int"))
    bar = ranked.agg(F.when(F.count(F.lit(1)) >= least, quartile).alias("threshold"), F.count(F.lit(1)).alias("rows"))
    return ranked.crossJoin(F.broadcast(bar)).groupBy("threshold", "rows").agg(F.count_if((F.col("rank") <= top) & (F.col("first") < F.col("threshold"))).alias("small"))


def trend_cross(a: DataFrame, b: DataFrame, sign_a: int, sign_b: int) -> DataFrame:
    """``a(code, a)`` and ``b(code, b)`` are change rates: signed z-scores summed; ``matches`` if both have their sign."""
    both = a.join(b, "code").filter("a is not null and b is not null")
    scored = z_scores(both, ("a", "za"), ("b", "zb")).withColumn("combined", sign_a * F.col("za") + sign_b * F.col("zb"))
    return min_max_scores(scored, "combined").withColumn("matches", (sign_a * F.col("a") > 0) & (sign_b * F.col("b") > 0))


def profile(cube: DataFrame, metrics: list[str], code: str, month_no: int) -> DataFrame:
    """All metrics of one cell: ``metric, value, percentile, change, direction``."""
    long = written(cube.select("code", "month_no", F.explode(F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*[F.col(m).cast("double") for m in metrics]))).alias("metric", "value")))
    now = percentile_ranks(at_month(long, month_no), "value", ["metric"]).filter(F.col("code") == code).select("metric", "value", "percentile")
    own = long.filter(F.col("code") == code).withColumn("code", F.col("metric"))
    return now.join(trends(own, "value").select(F.col("code").alias("metric"), "change", "direction"), "metric", "left")


def top_percent(ranked: DataFrame, percent: float) -> DataFrame:
    """The first ``percent`` of ranked rows, one at least."""
    return with_stats(ranked, n_=F.count(F.lit(1))).filter(F.col("rank") <= F.greatest(F.lit(1), F.ceil(F.col("n_") * percent / 100))).drop("n_")


def threshold(df: DataFrame, value: str, sign: str, bound: float) -> DataFrame:
    """Rows whose value compares; null and NaN never do."""
    test = {">": F.col(value) > bound, ">=": F.col(value) >= bound, "<": F.col(value) < bound, "<=": F.col(value) <= bound}[sign]
    return df.filter(F.coalesce(test & ~F.isnan(F.col(value).cast("double")), F.lit(False)))


def threshold_if(df: DataFrame, value: str, sign: str, bound: float, unit: str | None, metric_unit: str, composite: bool) -> DataFrame:
    """``threshold``, but all rows if the ranking is composite or the bound is in another unit than the metric."""
    return df if composite or (unit is not None and unit != metric_unit) else threshold(df, value, sign, bound)


def rank_word(value: str, rank: str) -> Column:
    """``ascending`` if there are three ranked rows or more and the first value is less than the last, else ``descending``."""
    up = (F.count(F.lit(1)) >= 3) & (F.min_by(value, rank) < F.max_by(value, rank))
    return F.when(up, "ascending").otherwise("descending")
