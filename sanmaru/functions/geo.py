"""Distances, bins and polygons as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius in km.
EARTH_KM = 6371.0088


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a1, a2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((a2 - a1) / 2), F.lit(2)) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), F.lit(2))
    return 2 * EARTH_KM * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def bin_key(x: Column, y: Column, size: float) -> Column:
    return F.concat_ws("_", F.floor(x / size).cast("string"), F.floor(y / size).cast("string"))


def bin_center(key: Column, size: float) -> tuple[Column, Column]:
    parts = F.split(key, "_")
    return tuple((F.element_at(parts, i).cast("double") + 0.5) * size for i in (1, 2))


def in_ring(lng: Column, lat: Column, ring: Column, boundary: bool = True) -> Column:
    """Even-odd rule for a closed ring of ``[lng, lat]``; points on its edges count as inside if ``boundary``."""
    last = F.size(ring) - 1
    edges = F.zip_with(F.slice(ring, F.lit(1), last), F.slice(ring, F.lit(2), last), lambda a, b: F.array(a[0], a[1], b[0], b[1]))

    def crosses(e: Column) -> Column:
        x1, y1, x2, y2 = (F.get(e, F.lit(i)) for i in range(4))
        return ((y1 > lat) != (y2 > lat)) & (lng < F.try_divide((x2 - x1) * (lat - y1), y2 - y1) + x1)

    def touches(e: Column) -> Column:
        x1, y1, x2, y2 = (F.get(e, F.lit(i)) for i in range(4))
        inside = lng.between(F.least(x1, x2), F.greatest(x1, x2)) & lat.between(F.least(y1, y2), F.greatest(y1, y2))
        return F.coalesce(inside & ((x2 - x1) * (lat - y1) == (y2 - y1) * (lng - x1)), F.lit(False))

    odd, on_edge = F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1, F.exists(edges, touches)
    return (odd | on_edge) if boundary else (odd & ~on_edge)


def in_polygon(lng: Column, lat: Column, rings: Column) -> Column:
    """Inside the first ring and in none of the others; edges, those of holes too, belong to the polygon."""
    holes = F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))
    return in_ring(lng, lat, F.element_at(rings, 1)) & ~F.exists(holes, lambda r: in_ring(lng, lat, r, boundary=False))
