"""Checks of boundary features and of facility records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sanmaru.functions.codes import first_known
from sanmaru.functions.shapes import holes_inside, ring_problem

#: Names of the supported reference systems, the text properties of a feature, and the bounds of the province.
SUPPORTED_CRS = ("CRS84", "EPSG:4326", "urn:ogc:def:crs:OGC:1.3:CRS84", "urn:ogc:def:crs:EPSG::4326")
REQUIRED = ("adm_nm", "adm_cd", "adm_cd2", "sgg", "sido", "sidonm", "sggnm")
PROVINCES = ("경상남도",)
BOUNDS = (127.5, 34.4, 129.6, 36.0)
#: Facility types in the order in which a label is searched for them, and the codes of the hospital register.
TYPES = ("약국", "요양병원", "종합병원", "치과의원", "한의원", "의원", "보건소", "병원")
TYPE_CODES = {
    "종합병원": ("01", "11"), "병원": ("21", "41", "92", "75"), "요양병원": ("28",), "의원": ("31",),
    "치과의원": ("51",), "한의원": ("93",), "보건소": ("71", "72", "73"), "약국": ("81",),
}


def crs_supported(name: Column) -> Column:
    return F.coalesce(name.isin(*SUPPORTED_CRS), F.lit(False))


def property_problem(properties: Column) -> Column:
    """Why the properties (a map of texts) of a feature are refused, or null."""
    get = lambda k: F.element_at(properties, k)
    blank = F.filter(F.array(*map(F.lit, REQUIRED)), lambda k: F.trim(F.coalesce(F.element_at(properties, k), F.lit(""))) == "")
    inside = reduce(lambda a, b: a | b, [get("adm_nm").startswith(p) for p in PROVINCES])
    return (
        F.when(F.size(blank) > 0, F.concat(F.lit("blank "), blank[0]))
        .when(~get("adm_cd").rlike(r"^\d{8}$"), "adm_cd")
        .when(~get("adm_cd2").rlike(r"^\d{10}$"), "adm_cd2")
        .when(~inside, "province")
    )


def geometry_problem(polygons: Column) -> Column:
    """Why a multi-polygon is refused, or null: it is empty, a ring is bad or leaves the bounds, or a hole leaves its ring."""
    rings = F.flatten(polygons)
    bad = F.filter(F.transform(rings, ring_problem), lambda p: p.isNotNull())
    west, south, east, north = BOUNDS
    out = F.exists(rings, lambda r: F.exists(r, lambda p: ~(p[0].between(west, east) & p[1].between(south, north))))
    return (
        F.when(F.coalesce(F.size(rings), F.lit(0)) < 1, "empty")
        .when(F.size(bad) > 0, bad[0])
        .when(out, "bounds")
        .when(F.exists(polygons, lambda p: ~holes_inside(p)), "hole")
    )


def validate_boundaries(features: DataFrame, crs: str, least: int = 150) -> DataFrame:
    """``feature_count, codes, west, south, east, north`` of ``features(properties, polygons)``, or an error at the first fault.

    Regions are administrative units, so the sorted codes fit one row. Repeated codes are found by counting.
    """
    if crs not in SUPPORTED_CRS:
        raise ValueError(f"unsupported reference system {crs}")
    p, code = F.col("properties"), lambda k: F.element_at("properties", k)
    problem = F.coalesce(property_problem(p), geometry_problem(F.col("polygons")))
    fine = F.when(problem.isNull(), F.lit(1)).otherwise(F.raise_error(F.concat(F.lit("bad feature: "), problem)).cast("int"))
    points = F.flatten(F.flatten("polygons"))
    edge = lambda f, i: f(F.transform(points, lambda q: q[i]))
    rows = features.select(fine.alias("fine"), code("adm_cd").alias("a"), code("adm_cd2").alias("b"), edge(F.array_min, 0).alias("w"), edge(F.array_min, 1).alias("s"), edge(F.array_max, 0).alias("e"), edge(F.array_max, 1).alias("n"))
    all_ = rows.agg(F.sum("fine").cast("int").alias("feature_count"), F.array_sort(F.collect_set("b")).alias("codes"), F.count_distinct("a").alias("distinct_"), F.min("w").alias("west"), F.min("s").alias("south"), F.max("e").alias("east"), F.max("n").alias("north"))
    n = F.coalesce("feature_count", F.lit(0))
    whole = (n >= least) & (F.size("codes") == n) & (F.col("distinct_") == n)
    checked = F.when(whole, n).otherwise(F.raise_error(F.lit("too few features or repeated codes")).cast("int"))
    return all_.select(checked.alias("feature_count"), "codes", "west", "south", "east", "north")


def type_of_label(label: Column) -> Column:
    """The first type that the label contains, or null."""
    return F.coalesce(*[F.when(F.contains(label, F.lit(t)), t) for t in TYPES])


def type_of_register(label: Column, code: Column) -> Column:
    """Facility type of the hospital register: by label, else by code."""
    name, number = F.trim(F.coalesce(label, F.lit(""))), F.trim(F.coalesce(code, F.lit("")))
    by_label = (
        F.when(name.contains("상급종합") | (name == "종합병원"), "종합병원").when(name == "요양병원", "요양병원")
        .when(name.isin("병원", "치과병원", "한방병원"), "병원").when(name == "의원", "의원").when(name.contains("치과"), "치과의원")
        .when(name.contains("한의"), "한의원").when(name.contains("보건"), "보건소").when(name.contains("약국"), "약국").otherwise(type_of_label(name))
    )
    by_code = F.coalesce(*[F.when(number.isin(*codes), kind) for kind, codes in TYPE_CODES.items()])
    return F.coalesce(by_label, by_code)


def register_facilities(rows: DataFrame) -> DataFrame:
    """``id, name, type, lat, lng, address, phone`` of register rows ``ykiho, yadmNm, clCdNm, clCd, XPos, YPos, addr, telno, index``.

    Rows without a name, a known type or a place in the province's rough bounds are passed over. Regions are assigned
    afterwards by ``cover.assign_regions``.
    """
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    lat, lng = F.trim("YPos").try_cast("double"), F.trim("XPos").try_cast("double")
    out = rows.select(text("ykiho").alias("given"), text("yadmNm").alias("name"), type_of_register(F.col("clCdNm"), F.col("clCd")).alias("type"), lat.alias("lat"), lng.alias("lng"), text("addr").alias("address"), text("telno").alias("phone"), "index")
    kept = out.filter(F.col("name").isNotNull() & F.col("type").isNotNull() & F.col("lat").between(34.2, 36.2) & F.col("lng").between(127.3, 129.8))
    made = F.format_string("hira-%s-%.5f-%.5f-%d", "name", "lat", "lng", F.col("index").cast("long"))
    return kept.select(F.coalesce("given", made).alias("id"), "name", "type", "lat", "lng", "address", "phone")


def strict_facilities(rows: DataFrame, column: str = "record") -> DataFrame:
    """Facilities of records (maps of texts) under any of their known keys; a record that lacks a required field is an error."""
    get = lambda *keys: first_known(*[F.element_at(F.col(column), k) for k in keys])
    need = lambda name, v, kind: F.when(v.isNotNull(), v).otherwise(F.raise_error(F.lit(f"facility without {name}")).cast(kind))
    number = lambda *keys: get(*keys).try_cast("double")
    listed = F.filter(F.transform(F.split(get("specialties", "departments", "dgsbjtCdNm"), ","), lambda s: F.trim(s)), lambda s: s != "")
    return rows.select(
        need("id", get("id", "facilityId", "ykiho"), "string").alias("id"), need("name", get("name", "facilityName", "yadmNm"), "string").alias("name"),
        need("type", type_of_label(get("type", "category", "facilityType", "clCdNm")), "string").alias("type"), need("code", get("adm_cd2", "admCd2", "admmCd"), "string").alias("code"),
        need("region", get("adm_nm", "admNm", "admmNm"), "string").alias("region"), need("latitude", number("lat", "latitude", "YPos"), "double").alias("lat"),
        need("longitude", number("lng", "longitude", "XPos"), "double").alias("lng"), F.when(F.size(listed) > 0, listed).alias("specialties"),
        get("address", "addr").alias("address"), get("phone", "telno").alias("phone"),
    )


def population_is_live(mode: Column, notes: Column) -> Column:
    """Live mode, and no note that speaks of population or households calls them synthetic or a base snapshot."""
    return F.coalesce(mode == "live", F.lit(False)) & ~F.exists(notes, lambda n: n.rlike("인구|세대") & n.rlike("합성|기준 스냅샷"))


def check_snapshot(docs: DataFrame, months: int = 13) -> DataFrame:
    """Snapshot documents with known modes, ``months`` labelled months and at least one region; others are an error."""
    fine = F.col("mode").isin("demo", "live") & (F.size("months") == months) & F.forall("months", lambda m: m.rlike(r"^\d{4}-(0[1-9]|1[0-2])$")) & (F.size("regions") > 0)
    mode = F.when(F.coalesce(fine, F.lit(False)), F.col("mode")).otherwise(F.raise_error(F.lit("bad snapshot")).cast("string"))
    return docs.withColumn("mode", mode)
