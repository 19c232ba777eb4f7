"""Number rules that every operator shares."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, digits: int = 2) -> Column:
    """Round halves toward plus infinity; Spark's ``round`` goes away from zero."""
    scale = 10.0**digits
    return F.floor(value * scale + 0.5) / scale


def percentage(part: Column, whole: Column) -> Column:
    """``part / whole * 100``, null unless ``whole`` is above 0."""
    return F.when(whole > 0, part / whole * 100)


def clamp(value: Column, low: float, high: float) -> Column:
    """``value`` kept in the range; null stays null, which ``greatest`` and ``least`` alone would lose."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def total(columns: list[Column]) -> Column:
    """Sum of columns with nulls as 0."""
    return reduce(add, [F.coalesce(c, F.lit(0)) for c in columns])


def sum_or_null(value: Column) -> Column:
    """Sum that is null if any member is null."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def sum_as_zero(value: Column) -> Column:
    """Sum with null members as 0."""
    return F.sum(F.coalesce(value, F.lit(0)))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean of known values; a null weight counts 0, and a total weight of 0 gives null."""
    w = F.when(value.isNotNull(), F.coalesce(weight.cast("double"), F.lit(0.0)))
    return F.sum(value * w) / F.nullif(F.sum(w), F.lit(0.0))


def vulnerability(density: Column, ratio: Column, distance: Column, count: Column) -> Column:
    """Weighted index of four 0-100 scores; null if one is null."""
    return clamp(0.35 * density + 0.25 * ratio + 0.25 * distance + 0.15 * count, 0.0, 100.0)


def standing(z: Column) -> Column:
    """Five-level word for a z-score."""
    return F.when(z >= 1.5, "very high").when(z >= 0.5, "high").when(z > -0.5, "average").when(z > -1.5, "low").when(z.isNotNull(), "very low")
