"""Region codes, months and raw text fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_code(raw: Column) -> Column:
    """Digits only; drops byte order marks and quotes."""
    return F.regexp_replace(raw, "[^0-9]", "")


def pad_code(code8: Column) -> Column:
    return F.concat(code8, F.lit("00"))


def parent_code(code: Column) -> Column:
    return F.substring(code, 1, 5)


def parent_name(name: Column) -> Column:
    return F.concat_ws(" ", F.slice(F.split(name, r"\s+"), 1, 2))


def month_no(label: Column) -> Column:
    """``YYYY-MM`` as year * 12 + month - 1."""
    return F.substring(label, 1, 4).cast("int") * 12 + F.substring(label, 6, 2).cast("int") - 1


def month_label(no: Column) -> Column:
    return F.concat(F.lpad(F.floor(no / 12).cast("string"), 4, "0"), F.lit("-"), F.lpad((no % 12 + 1).cast("string"), 2, "0"))


def normal_month(raw: Column) -> Column:
    """``YYYYMM`` or ``YYYY-MM`` as ``YYYY-MM``; null if it is no month."""
    flat = F.regexp_replace(raw, "-", "")
    return F.when(flat.rlike("^[0-9]{4}(0[1-9]|1[0-2])$"), F.concat(F.substring(flat, 1, 4), F.lit("-"), F.substring(flat, 5, 2)))


def quarter_label(yq: Column) -> Column:
    """``YYYYQ`` as its closing month."""
    return F.concat(F.substring(yq, 1, 4), F.lit("-"), F.lpad((F.substring(yq, 5, 1).cast("int") * 3).cast("string"), 2, "0"))


def hour_label(raw: Column) -> Column:
    trimmed = F.trim(raw)
    return F.when(F.length(trimmed) == 1, F.lpad(trimmed, 2, "0")).otherwise(trimmed)


def minutes(clock: Column) -> Column:
    """``HH:MM`` as minutes; null outside 00:00 to 23:59."""
    h, m = F.regexp_extract(clock, r"^(\d{1,2}):(\d{2})$", 1), F.regexp_extract(clock, r"^(\d{1,2}):(\d{2})$", 2)
    return F.when((h != "") & (h.try_cast("int") < 24) & (m.try_cast("int") < 60), h.try_cast("int") * 60 + m.try_cast("int"))


def field_number(raw: Column) -> Column:
    """A text field as a number: an empty field is 0, one that is missing or no number is null."""
    return F.when(F.trim(raw) == "", F.lit(0.0)).otherwise(F.trim(raw).try_cast("double"))


def first_known(*columns: Column) -> Column:
    """First column that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in columns])


def count_number(raw: Column) -> Column:
    """A count with thousands separators; null unless it is 0 or more."""
    value = F.regexp_replace(raw, ",", "").try_cast("double")
    return F.when(value >= 0, value)


def unit_label(codes_all_ten: Column, codes_all_five: Column) -> Column:
    return F.when(codes_all_ten, "dong").when(codes_all_five, "district").otherwise("grid")


def base_unit(unit: Column) -> Column:
    return F.trim(F.element_at(F.split(unit, "/"), 1))


def month_run(last: Column, n: int) -> Column:
    """Labels of the ``n`` months that end with month number ``last``."""
    return F.transform(F.sequence(last - (n - 1), last), month_label)


def month_windows(months: Column, most: int) -> Column:
    """Sorted months in windows of at most ``most``."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(months) / most).cast("int") - 1, F.lit(0)))
    return F.transform(starts, lambda i: F.slice(months, i * most + 1, F.lit(most)))


def district_name(name: Column, province: str) -> Column:
    """City and ward of a region's name without its province, or the first word if no ward follows a city."""
    words = F.split(F.regexp_replace(name, f"^{province}\\s*", ""), r"\s+")
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    return F.when(first.endswith("시") & F.coalesce(second.endswith("구"), F.lit(False)), F.concat_ws(" ", first, second)).otherwise(F.coalesce(first, F.lit("")))


def hours_map(json: Column) -> Column:
    """Opening hours by day of a JSON object: texts and nulls stay, other values go; null if nothing is left or it is no object."""
    v = F.try_parse_json(json)
    days = F.transform_values(F.try_variant_get(v, "$", "map<string, variant>"), lambda _, x: F.struct(F.schema_of_variant(x).alias("kind"), F.try_variant_get(x, "$", "string").alias("text")))
    kept = F.transform_values(F.map_filter(days, lambda _, x: x["kind"].isin("STRING", "VOID")), lambda _, x: x["text"])
    return F.when(F.size(kept) > 0, kept)
