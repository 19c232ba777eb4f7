"""Checks of rings and polygons as built-in expressions. A ring is an array of ``[lng, lat]``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sanmaru.functions.geo import EARTH_KM, in_ring


def edges(ring: Column) -> Column:
    """Edges as ``x1, y1, x2, y2, i``."""
    n = F.size(ring) - 1
    pairs = F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")))
    return F.transform(pairs, lambda e, i: F.struct(e["x1"].alias("x1"), e["y1"].alias("y1"), e["x2"].alias("x2"), e["y2"].alias("y2"), i.alias("i")))


def side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Which side of a-b the point is on: -1, 0 or 1."""
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def cross_properly(e: Column, f: Column) -> Column:
    """Whether two edges cross at an inner point of both."""
    a = side(e["x1"], e["y1"], e["x2"], e["y2"], f["x1"], f["y1"]) * side(e["x1"], e["y1"], e["x2"], e["y2"], f["x2"], f["y2"])
    b = side(f["x1"], f["y1"], f["x2"], f["y2"], e["x1"], e["y1"]) * side(f["x1"], f["y1"], f["x2"], f["y2"], e["x2"], e["y2"])
    return (a < 0) & (b < 0)


def meet(e: Column, f: Column) -> Column:
    """Whether two edges share a point: they cross, touch or lie on each other."""

    def on(g: Column, x: Column, y: Column) -> Column:
        box = x.between(F.least(g["x1"], g["x2"]), F.greatest(g["x1"], g["x2"])) & y.between(F.least(g["y1"], g["y2"]), F.greatest(g["y1"], g["y2"]))
        return box & (side(g["x1"], g["y1"], g["x2"], g["y2"], x, y) == 0)

    return cross_properly(e, f) | on(e, f["x1"], f["y1"]) | on(e, f["x2"], f["y2"]) | on(f, e["x1"], e["y1"]) | on(f, e["x2"], e["y2"])


def self_intersects(ring: Column) -> Column:
    listed = edges(ring)
    return F.exists(listed, lambda e: F.exists(listed, lambda f: (f["i"] > e["i"]) & cross_properly(e, f)))


def rings_intersect(a: Column, b: Column) -> Column:
    """Whether edges of two rings share a point."""
    return F.exists(edges(a), lambda e: F.exists(edges(b), lambda f: meet(e, f)))


def ring_problem(ring: Column) -> Column:
    """Why a ring is refused, or null: it has under four positions, is open, leaves the globe or crosses itself."""
    return (
        F.when(ring.isNull() | (F.size(ring) < 4), "short")
        .when(F.element_at(ring, 1) != F.element_at(ring, -1), "open")
        .when(F.exists(ring, lambda p: ~F.coalesce(p[0].between(-180.0, 180.0) & p[1].between(-90.0, 90.0), F.lit(False))), "outside")
        .when(self_intersects(ring), "crossing")
    )


def holes_inside(rings: Column) -> Column:
    """Whether every hole starts inside the first ring and crosses none of its edges."""
    outer = F.element_at(rings, 1)
    holes = F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))
    return F.forall(holes, lambda h: in_ring(h[0][0], h[0][1], outer) & ~rings_intersect(h, outer))


def area_km2(ring: Column) -> Column:
    """Spherical area of a ring by the trapezoid rule on the sine of latitude."""
    parts = F.transform(edges(ring), lambda e: F.radians(e["x2"] - e["x1"]) * (2 + F.sin(F.radians(e["y1"])) + F.sin(F.radians(e["y2"]))))
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)) * EARTH_KM * EARTH_KM / 2


def polygon_area_km2(rings: Column) -> Column:
    """Spherical area of the first ring less those of the others."""
    return F.aggregate(F.transform(rings, lambda r, i: area_km2(r) * F.when(i == 0, 1.0).otherwise(-1.0)), F.lit(0.0), lambda s, x: s + x)


def interior_point(rings: Column) -> Column:
    """A place ``lng, lat`` inside a polygon (or of all rings of a multi-polygon), clear of its edges; null if it has no area.

    The scanline lies halfway between the corners next below and next above the middle, so it meets no corner. The
    place is the middle of the widest piece of it that is inside by the even-odd rule.
    """
    let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  the value is worked out once

    def place(y: Column) -> Column:
        met = F.filter(F.flatten(F.transform(rings, edges)), lambda e: (e["y1"] > y) != (e["y2"] > y))
        return let(F.array_sort(F.transform(met, lambda e: e["x1"] + (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]))), lambda xs: widest(xs, y))

    def widest(xs: Column, y: Column) -> Column:
        piece = lambda i: F.struct((F.get(xs, 2 * i + 1) - F.get(xs, 2 * i)).alias("width"), (-i).alias("no"), ((F.get(xs, 2 * i) + F.get(xs, 2 * i + 1)) / 2).alias("x"))
        best = F.array_max(F.when(F.size(xs) >= 2, F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(xs) / 2).cast("int") - 1, F.lit(0))), piece)))
        return let(best, lambda b: F.when(b["width"] > 0, F.struct(b["x"].alias("lng"), y.alias("lat"))))

    def scanline(ys: Column) -> Column:
        middle = (F.get(ys, F.lit(0)) + F.element_at(ys, -1)) / 2
        return (F.array_max(F.filter(ys, lambda v: v <= middle)) + F.array_min(F.filter(ys, lambda v: v > middle))) / 2

    ys = F.array_sort(F.array_distinct(F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p[1])))))
    return let(ys, lambda listed: let(scanline(listed), place))


def swap_points(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.struct(p[1].alias("lat"), p[0].alias("lng")))
