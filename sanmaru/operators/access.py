"""Distance joins between regions and facilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sanmaru.functions.geo import haversine_km
from sanmaru.session import written

#: Degrees of latitude in a km, rounded up so that a band never misses a neighbour.
DEGREE_PER_KM = 1 / 110.5


def _cells(band: Column, km: float) -> Column:
    """Cells round the globe in a latitude band: each at least as wide as ``km`` reaches there and in the next bands."""
    degrees = km * DEGREE_PER_KM
    widest = F.cos(F.radians(F.least(F.lit(90.0), F.greatest(F.abs(band - 1), F.abs(band + 2)) * degrees)))
    return F.greatest(F.lit(1), F.floor(F.lit(360.0) * widest / (1.2 * degrees))).cast("long")


def _cell(lng: Column, band: Column, km: float) -> Column:
    return F.pmod(F.floor((lng + 180) / 360 * _cells(band, km)).cast("long"), _cells(band, km))


def _band(lat: Column, km: float) -> Column:
    return F.floor(lat / (km * DEGREE_PER_KM)).cast("long")


def _reached(points: DataFrame, km: float) -> DataFrame:
    """A row for each ``band, cell`` that ``km`` reaches from the point: its own and the neighbours, round the globe."""
    near = points.withColumn("band", F.explode(F.array(*[_band(F.col("lat"), km) + i for i in (-1, 0, 1)])))
    cell, cells = _cell(F.col("lng"), F.col("band"), km), _cells(F.col("band"), km)
    return near.withColumn("cell", F.explode(F.array_distinct(F.array(*[F.pmod(cell + i, cells) for i in (-1, 0, 1)]))))


def access_pairs(origins: DataFrame, facilities: DataFrame, km: float) -> DataFrame:
    """``code, km``: a row for each facility at most ``km`` from an origin.

    Both sides are dealt by cells of latitude and longitude of the radius, so the join is an equi-join at any size. A
    radius of 0 finds facilities at the very place.
    """
    if not 0 <= km < float("inf"):
        raise ValueError("the radius is a number from 0 on")
    size = max(km, 0.001)
    band = _band(F.col("lat"), size)
    near = facilities.select(F.col("lat").alias("f_lat"), F.col("lng").alias("f_lng"), band.alias("band"), _cell(F.col("lng"), band, size).alias("cell"))
    pairs = _reached(origins.select("code", "lat", "lng"), size).join(near, ["band", "cell"])
    return pairs.select("code", haversine_km(F.col("lat"), F.col("lng"), F.col("f_lat"), F.col("f_lng")).alias("km")).filter(F.col("km") <= km)


def within_radius(origins: DataFrame, facilities: DataFrame, km: float) -> DataFrame:
    """``code, within``: facilities at most ``km`` away; origins without one are not listed."""
    return access_pairs(origins, facilities, km).groupBy("code").agg(F.count(F.lit(1)).alias("within"))


def nearest(origins: DataFrame, facilities: DataFrame, start_km: float = 8.0) -> DataFrame:
    """``code, nearest_km``: distance to the nearest facility, null if there is none.

    Rings of cells grow fourfold until every origin has a facility no farther than its ring reaches. Each ring
    is written before the next one reads what it left open, so that plans don't nest. A code with several origins takes
    the smallest distance of them.
    """
    open_, done, km = origins.select("code", "lat", "lng").distinct(), None, start_km
    places = written(facilities.select(F.col("lat").alias("f_lat"), F.col("lng").alias("f_lng")).filter("f_lat is not null and f_lng is not null").distinct())
    while km < 80_400 and not places.isEmpty():  # the last ring spans the globe
        near = places.withColumn("band", _band(F.col("f_lat"), km)).withColumn("cell", _cell(F.col("f_lng"), F.col("band"), km))
        best = F.min(haversine_km(F.col("lat"), F.col("lng"), F.col("f_lat"), F.col("f_lng")))
        ring = written(_reached(open_, km).join(near, ["band", "cell"], "left").groupBy("code", "lat", "lng").agg(best.alias("km")))
        found = ring.filter(F.col("km") <= km).groupBy("code").agg(F.min("km").alias("nearest_km"))
        done = found if done is None else done.unionByName(found)
        open_, km = ring.filter((F.col("km").isNull() | (F.col("km") > km)) & F.col("lat").isNotNull() & F.col("lng").isNotNull()).drop("km"), km * 4
        if open_.isEmpty():
            break
    if done is None:
        return origins.select("code", F.lit(None).cast("double").alias("nearest_km"))
    return origins.select("code").join(done.groupBy("code").agg(F.min("nearest_km").alias("nearest_km")), "code", "left")


def access(origins: DataFrame, facilities: DataFrame, km: float) -> DataFrame:
    """``code, nearest_km, within, own``: nearest facility, count in the radius and count with the same code."""
    own = facilities.groupBy("code").agg(F.count(F.lit(1)).alias("own"))
    joined = nearest(origins, facilities).join(within_radius(origins, facilities, km), "code", "left").join(own, "code", "left")
    return joined.select("code", "nearest_km", F.coalesce("within", F.lit(0)).alias("within"), F.coalesce("own", F.lit(0)).alias("own"))


def number_cells(rows: DataFrame) -> DataFrame:
    """Numbers cells of one code from north to south, west to east; a lone cell has none."""
    order = W.partitionBy("code").orderBy(F.desc("lat"), "lng", "id")
    return rows.withColumn("number", F.when(F.count(F.lit(1)).over(W.partitionBy("code")) > 1, F.row_number().over(order)))


def night_open(hours: Column) -> Column:
    """Any day range that starts before 06:00, ends at 20:00 or later, or ends before it starts."""
    clock = lambda v, i: F.get(F.split(v, "-"), F.lit(i))
    late = lambda v: (clock(v, 0) < "06:00") | (clock(v, 1) >= "20:00") | (clock(v, 1) < clock(v, 0))
    return F.coalesce(F.exists(F.map_values(hours), lambda v: F.coalesce((F.trim(v) != "") & late(v), F.lit(False))), F.lit(False))


def weekend_open(hours: Column) -> Column:
    known = lambda d: F.coalesce(F.length(F.element_at(hours, d)), F.lit(0)) > 0
    return F.coalesce(known("saturday") | known("sunday"), F.lit(False))
