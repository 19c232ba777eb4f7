"""Raw monthly feeds to metrics. Inputs are rows of typed fields; each feed keeps its own divisor and null rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sanmaru.functions.numeric import half_up, percentage

#: Hours of the day and of the night, and least adults of a grid bin whose averages may be shown.
DAY_HOURS, NIGHT_HOURS, LEAST_ADULTS = tuple(range(9, 19)), (22, 23, 0, 1, 2, 3, 4, 5), 30
#: Share of a dong's population that its grid bins must cover.
COVERAGE = 0.9


def valid_codes(rows: DataFrame, code: str = "code") -> DataFrame:
    return rows.filter(F.length(code) == 10)


def card_totals(rows: DataFrame) -> DataFrame:
    """``code, month, card_sales`` (millions, one digit) and ``card_txns``."""
    return rows.groupBy("code", "month").agg(half_up(F.sum("amount") / 1e6, 1).alias("card_sales"), F.sum("txns").cast("long").alias("card_txns"))


def add_sums(first: DataFrame, *others: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of several files of one feed, added by key."""
    rows = first
    for o in others:
        rows = rows.unionByName(o)
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in first.columns if c not in keys])


def share_sums(rows: DataFrame, parts: dict[str, Column], base: dict[str, Column] | None = None) -> DataFrame:
    """``code, month``, the amount of each part and of its base, and ``total``."""
    amount = lambda c: F.sum(F.when(c, F.col("amount")).otherwise(0.0))
    bases = [amount((base or {}).get(n, F.lit(True))).alias(f"{n}_base") for n in parts]
    return rows.groupBy("code", "month").agg(*[amount(c).alias(n) for n, c in parts.items()], *bases, F.sum("amount").alias("total"))


def finish_shares(sums: DataFrame) -> DataFrame:
    """Percentages of sums as ``share_sums`` gives them."""
    names = [c for c in sums.columns if f"{c}_base" in sums.columns]
    return sums.select("code", "month", *[half_up(percentage(F.col(n), F.col(f"{n}_base")), 1).alias(n) for n in names], half_up(F.col("total") / 1e6, 1).alias("card_sales"))


def shares(rows: DataFrame, parts: dict[str, Column], base: dict[str, Column] | None = None) -> DataFrame:
    """Percentages of the amounts that meet a condition; of all amounts, or of those that meet ``base[name]``.

    A base of 0 or less gives null. ``card_sales`` is the total in millions.
    """
    return finish_shares(share_sums(rows, parts, base))


def hourly_sums(rows: DataFrame) -> DataFrame:
    part = lambda hours: F.sum(F.when(F.col("hour").isin(*hours), F.col("amount")).otherwise(0.0))
    return rows.groupBy("code", "month").agg(part(DAY_HOURS).alias("day"), part(NIGHT_HOURS).alias("night"), F.sum("amount").alias("total"))


def finish_hourly(sums: DataFrame) -> DataFrame:
    """Sales by day and night in millions, and the night's share of all hours."""
    share = half_up(percentage(F.col("night"), F.col("total")), 1)
    return sums.select("code", "month", half_up(F.col("day") / 1e6, 1).alias("day_sales"), half_up(F.col("night") / 1e6, 1).alias("night_sales"), share.alias("night_share"))


def hourly(rows: DataFrame) -> DataFrame:
    return finish_hourly(hourly_sums(rows))


def living(rows: DataFrame) -> DataFrame:
    """Mean over rows of ``total``, and the elderly share of the sums."""
    return rows.groupBy("code", "month").agg(half_up(F.sum("total") / F.count(F.lit(1)), 0).alias("living_total"), half_up(percentage(F.sum("elderly"), F.sum("total")), 1).alias("elderly_ratio"))


def day_night(rows: DataFrame) -> DataFrame:
    """Means over day rows and night rows, and their ratio; null if the night's is 0."""
    mean = lambda hours: F.avg(F.when(F.col("hour").isin(*hours), F.col("total")))
    day, night = mean(DAY_HOURS), mean(NIGHT_HOURS)
    return rows.groupBy("code", "month").agg(half_up(day, 0).alias("day_population"), half_up(night, 0).alias("night_population"), half_up(percentage(day, night), 1).alias("day_night_ratio"))


def daily_mean(rows: DataFrame) -> DataFrame:
    """Totals divided by the distinct dates; dates are counted after one partial aggregation by date."""
    by_date = rows.groupBy("code", "month", "date").agg(F.sum("total").alias("total"))
    return by_date.groupBy("code", "month").agg(half_up(F.sum("total") / F.count(F.lit(1)), 0).alias("daily"))


def both_flows(inflow: DataFrame, outflow: DataFrame) -> DataFrame:
    """Full outer join of two daily means; the net needs both."""
    joined = inflow.withColumnRenamed("daily", "inflow_total").join(outflow.withColumnRenamed("daily", "outflow_total"), ["code", "month"], "full_outer")
    return joined.withColumn("net_flow", F.col("inflow_total") - F.col("outflow_total"))


def credit_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    weighted = [F.sum(F.col(c) * F.col("pop")).alias(c) for c in ("income", "score")]
    return rows.groupBy(*keys).agg(F.sum("pop").alias("pop"), *weighted, *[F.sum(c).alias(c) for c in ("holders", "spend", "economic")])


def finish_credit(sums: DataFrame, keys: list[str], least: int = 0) -> DataFrame:
    """Population-weighted means and ratios of sums; averages are null at a population of 0, or under ``least``."""
    pop = F.col("pop")
    shown = lambda c: F.when((pop > 0) & (pop >= least), c)
    per = lambda c, d: shown(half_up(F.col(c) / F.nullif(F.col(d), F.lit(0)), 0))
    return sums.select(*keys, pop.alias("pop_total"), per("income", "pop").alias("avg_income"), per("score", "pop").alias("credit_score"), shown(half_up(percentage(F.col("holders"), pop), 1)).alias("loan_ratio"), per("spend", "economic").alias("card_spend"))


def credit(rows: DataFrame, keys: list[str], least: int = 0) -> DataFrame:
    return finish_credit(credit_sums(rows, keys), keys, least)


def external_moves(rows: DataFrame) -> DataFrame:
    """Moves from a known district (not 99999) to another; blanks never count."""
    known = (F.coalesce("previous", F.lit("")) != "") & (F.coalesce("current", F.lit("")) != "") & (F.col("previous") != "99999")
    return rows.filter(known & (F.col("previous") != F.col("current")))


def migration(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Arrivals by cell and departures by district, on each cell and quarter."""
    moved = external_moves(rows)
    arrived = moved.groupBy("quarter", "code").agg(F.sum("n").alias("move_in"))
    left = moved.groupBy("quarter", F.col("previous").alias("sgg")).agg(F.sum("n").alias("move_out_sgg"))
    grid = cells.select("code", "sgg").crossJoin(F.broadcast(moved.select("quarter").distinct()))
    return grid.join(arrived, ["quarter", "code"], "left").join(left, ["quarter", "sgg"], "left").select("quarter", "code", F.coalesce("move_in", F.lit(0)).alias("move_in"), "move_out_sgg")


def commute_sums(rows: DataFrame) -> DataFrame:
    """Each row counts for its workplace (jobs) and its home (workers, outbound)."""
    none = F.lit(0).cast("long")
    jobs = rows.select("quarter", F.col("work").alias("code"), F.col("n").alias("jobs_in"), none.alias("workers"), none.alias("outbound"))
    homes = rows.select("quarter", F.col("home").alias("code"), none.alias("jobs_in"), F.col("n").alias("workers"), F.when(F.col("home") != F.col("work"), F.col("n")).otherwise(0).alias("outbound"))
    return add_sums(jobs, homes, keys=["quarter", "code"])


def finish_commute(sums: DataFrame) -> DataFrame:
    """No residents give null ratios."""
    ratio = lambda c: half_up(percentage(F.col(c), F.col("workers")), 1)
    return sums.select("quarter", "code", "jobs_in", ratio("outbound").alias("outbound_ratio"), ratio("jobs_in").alias("job_ratio"))


def commute(rows: DataFrame) -> DataFrame:
    return finish_commute(commute_sums(rows))


def dedup_last(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of each key. Partial maxima before the shuffle keep repeated keys small."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*keys, "r.*")


def dedup_first(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), seq).alias("r")).select(*keys, "r.*")


def age_buckets(rows: DataFrame) -> DataFrame:
    """``code, age, n`` as youth (to 14), working (15 to 64) and elderly (from 65)."""
    return rows.groupBy("code").agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(k) for k, c in (("youth", F.col("age") <= 14), ("working", F.col("age").between(15, 64)), ("elderly", F.col("age") >= 65))])


def merge_all_or_nothing(base: DataFrame, update: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Updated values if every key of ``base`` has one, else the base as it is; decided inside the plan."""
    fresh = update.select(*keys, F.col(value).alias("fresh_"))
    joined = base.join(fresh, keys, "left")
    whole = joined.agg((F.count(F.lit(1)) == F.count("fresh_")).alias("whole_"))
    return joined.crossJoin(F.broadcast(whole)).withColumn(value, F.when(F.col("whole_"), F.col("fresh_")).otherwise(F.col(value))).drop("fresh_", "whole_")


def join_required(base: DataFrame, values: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``base`` with the ``column`` of ``values``; a key of ``base`` that ``values`` lacks, or has as null, is an error."""
    found = base.join(values.select(*keys, column), keys, "left")
    missing = F.concat(F.lit(f"no {column} for "), F.to_json(F.struct(*keys)))
    kind = dict(values.dtypes)[column]
    return found.withColumn(column, F.when(F.col(column).isNotNull(), F.col(column)).otherwise(F.raise_error(missing).cast(kind)))


def merge_with_zero(base: DataFrame, update: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Updated values; keys without one get 0."""
    return base.drop(value).join(update.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def consecutive_months(series: DataFrame, n: int = 13) -> DataFrame:
    """``code, consecutive``: whether its latest ``n`` months follow one another."""
    recent = series.select("code", "month_no").distinct().withColumn("k", F.row_number().over(W.partitionBy("code").orderBy(F.desc("month_no")))).filter(F.col("k") <= n)
    return recent.groupBy("code").agg(((F.count(F.lit(1)) == n) & (F.max("month_no") - F.min("month_no") == n - 1)).alias("consecutive"))


def some_rows(df: DataFrame, message: str) -> DataFrame:
    """``df``, or an error if it has no rows; decided inside the plan."""
    counted = df.limit(1).agg(F.count(F.lit(1)).alias("some_"))
    checked = counted.select(F.when(F.col("some_") > 0, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")).alias("some_"))
    columns = [f"d_.{c}" for c in df.columns]
    return checked.alias("c_").join(df.alias("d_"), F.col("c_.some_"), "left").select(*columns)
