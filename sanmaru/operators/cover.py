"""Point-in-polygon joins over an adaptive quadtree cover of multi-polygons.

A region is covered by quadtree cells: *border* cells that an edge may touch, and *inner* cells that lie inside. Cells
with many edges are split, so that borders stay narrow where shapes are fine. Points find their cells by an equi-join;
inner cells need no test, and points in border cells are tested against the edges of their own horizontal strip only, so
no row ever holds a whole polygon.

Cell sizes are powers of two, so that cell bounds are exact in floating point; the test whether an edge touches a cell
errs on the side of touching.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sanmaru.session import broadcast_upto, written

#: Levels of the largest and smallest cells: a cell of level n is 2^-n degrees wide. Strips are as high as the smallest cells.
COARSE, FINE = 2, 9
#: Edges that a cell may have before it is split, and cells that may be broadcast.
EDGES, BROADCAST_CELLS = 16, 500_000


def _bad_ring(ring: Column) -> Column:
    """A ring that is null, has under four positions, is open or holds a position without two finite numbers."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    position = lambda p: F.coalesce(p.isNotNull() & finite(F.get(p, F.lit(0))) & finite(F.get(p, F.lit(1))), F.lit(False))
    first, last = F.element_at(ring, 1), F.element_at(ring, -1)
    closed = (F.get(first, F.lit(0)) == F.get(last, F.lit(0))) & (F.get(first, F.lit(1)) == F.get(last, F.lit(1)))
    return ~F.coalesce((F.size(ring) >= 4) & F.forall(ring, position) & closed, F.lit(False))


def sound_regions(regions: DataFrame) -> DataFrame:
    """``code, ordinal, polygons`` of the regions whose geometry can be used; others are passed over. ``rings`` stand for a single polygon."""
    shape = F.col("polygons") if "polygons" in regions.columns else F.array("rings")
    rows = regions.select("code", "ordinal", shape.alias("polygons"))
    fine = F.forall("polygons", lambda p: F.coalesce(F.size(p) > 0, F.lit(False)) & ~F.exists(p, _bad_ring))
    return rows.filter(F.coalesce((F.size("polygons") > 0) & fine, F.lit(False)))


def edge_rows(regions: DataFrame) -> DataFrame:
    """``code, ordinal, part, ring, x1, y1, x2, y2``: a row for each edge of usable regions."""
    parts = sound_regions(regions).select("code", "ordinal", F.posexplode("polygons").alias("part", "rings"))
    rings = parts.select("code", "ordinal", "part", F.posexplode("rings").alias("ring", "points"))
    n = F.size("points") - 1
    pairs = F.arrays_zip(F.slice("points", F.lit(1), n).alias("a"), F.slice("points", F.lit(2), n).alias("b"))
    out = rings.select("code", "ordinal", "part", "ring", F.explode(pairs).alias("e"))
    at = lambda end, i: F.get(F.col(f"e.{end}"), F.lit(i))
    return out.select("code", "ordinal", "part", "ring", at("a", 0).alias("x1"), at("a", 1).alias("y1"), at("b", 0).alias("x2"), at("b", 1).alias("y2"))


def _span(low: Column, high: Column, level: int) -> Column:
    return F.sequence(F.floor(low * 2.0**level), F.floor(high * 2.0**level))


def _touches(level: int) -> Column:
    """Whether the edge ``x1, y1, x2, y2`` may touch the closed cell ``ix, iy``: the cell's corners aren't all on one side of its line."""
    size = 2.0**-level
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    corner = lambda i, j: dx * ((F.col("iy") + j) * size - F.col("y1")) - dy * ((F.col("ix") + i) * size - F.col("x1"))
    corners, slack = [corner(i, j) for i in (0, 1) for j in (0, 1)], (F.abs(dx) + F.abs(dy)) * 1e-9
    overlap = (F.greatest("x1", "x2") >= F.col("ix") * size) & (F.least("x1", "x2") <= (F.col("ix") + 1) * size)
    overlap &= (F.greatest("y1", "y2") >= F.col("iy") * size) & (F.least("y1", "y2") <= (F.col("iy") + 1) * size)
    return overlap & (F.least(*corners) <= slack) & (F.greatest(*corners) >= -slack)


_CELL = ["code", "ordinal", "ix", "iy"]
_EDGE = ["x1", "y1", "x2", "y2"]


def cover(edges: DataFrame, most: int = EDGES, coarse: int = COARSE, fine: int = FINE) -> DataFrame:
    """``level, ix, iy, code, ordinal, inner``: cells of each region of ``edges``; cells outside are not listed.

    Each level is written once. A level that leaves no cell with over ``most`` edges is the last.
    """
    # a cell listed on the lower or left side of an edge's range catches edges that run along a cell's upper or right bound
    near = lambda level: edges.withColumn("ix", F.explode(_span(F.least("x1", "x2") - 2.0**-level / 2, F.greatest("x1", "x2"), level))).withColumn("iy", F.explode(_span(F.least("y1", "y2") - 2.0**-level / 2, F.greatest("y1", "y2"), level)))
    touching = written(near(coarse).filter(_touches(coarse)).select(*_CELL, *_EDGE))
    box = edges.groupBy("code", "ordinal").agg(*[f(F.least(f"{v}1", f"{v}2") if f is F.min else F.greatest(f"{v}1", f"{v}2")).alias(f"{v}_{f.__name__}") for v in "xy" for f in (F.min, F.max)])
    open_ = box.withColumn("ix", F.explode(_span(F.col("x_min"), F.col("x_max"), coarse))).withColumn("iy", F.explode(_span(F.col("y_min"), F.col("y_max"), coarse))).select(_CELL)
    border, empty = [], []
    for level in range(coarse, fine + 1):
        counts = touching.groupBy(_CELL).agg(F.count(F.lit(1)).alias("n"))
        full = counts.filter(F.col("n") > most).select(_CELL) if level < fine else None
        more = full is not None and bool(full.limit(1).count())
        border.append((counts.filter(F.col("n") <= most) if more else counts).select(F.lit(level).alias("level"), *_CELL))
        empty.append(open_.join(counts, _CELL, "left_anti").select(F.lit(level).alias("level"), *_CELL))
        if not more:
            break
        child = lambda df: df.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("ix", F.col("ix") * 2 + F.col("q") % 2).withColumn("iy", F.col("iy") * 2 + F.floor(F.col("q") / 2)).drop("q")
        full = written(full)
        open_ = child(full)
        touching = written(child(touching.join(broadcast_upto(full), _CELL, "left_semi")).filter(_touches(level + 1)))
    union = lambda parts: reduce(DataFrame.union, parts)
    size = F.pow(F.lit(2.0), -F.col("level"))
    centers = union(empty).select("level", *_CELL, ((F.col("ix") + 0.5) * size).alias("lng"), ((F.col("iy") + 0.5) * size).alias("lat"))
    inner = _inside(centers, ["level", *_CELL], strips(edges))
    listed = union(border).withColumn("inner", F.lit(False)).unionByName(inner.withColumn("inner", F.lit(True)))
    return listed.select("level", "ix", "iy", "code", "ordinal", "inner")


def strips(edges: DataFrame, level: int = FINE) -> DataFrame:
    """``edges`` with the ``strip`` of each height they reach."""
    return edges.withColumn("strip", F.explode(_span(F.least("y1", "y2"), F.greatest("y1", "y2"), level)))


def _inside(points: DataFrame, keys: list[str], stripped: DataFrame, level: int = FINE) -> DataFrame:
    """``keys`` of the rows of ``points(keys, code, lng, lat)`` that lie in their own region.

    Inside means: for some part, inside or on the first ring and strictly inside none of the others.
    """
    x, y = F.col("lng"), F.col("lat")
    crosses = ((F.col("y1") > y) != (F.col("y2") > y)) & (x < F.try_divide((F.col("x2") - F.col("x1")) * (y - F.col("y1")), F.col("y2") - F.col("y1")) + F.col("x1"))
    on = x.between(F.least("x1", "x2"), F.greatest("x1", "x2")) & y.between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    on &= (F.col("x2") - F.col("x1")) * (y - F.col("y1")) == (F.col("y2") - F.col("y1")) * (x - F.col("x1"))
    met = points.withColumn("strip", F.floor(y * 2.0**level)).join(stripped.drop("ordinal"), ["code", "strip"])
    rings = met.groupBy(*keys, "part", "ring").agg((F.count_if(F.coalesce(crosses, F.lit(False))) % 2 == 1).alias("odd"), F.bool_or(on).alias("edge"))
    outer, hole = (F.col("ring") == 0) & (F.col("odd") | F.col("edge")), (F.col("ring") > 0) & F.col("odd") & ~F.col("edge")
    parts = rings.groupBy(*keys, "part").agg(F.bool_or(outer).alias("outer"), F.bool_or(hole).alias("hole")).filter("outer and not hole")
    return parts.select(*keys).distinct()


def cell_hits(points: DataFrame, cells: DataFrame) -> DataFrame:
    """``points(id, lat, lng)`` with the cells of a cover that they lie in: one row for each region and level met."""
    listed = cells.groupBy("level").count().collect()  # at most FINE - COARSE + 1 rows
    levels, few = sorted(r.level for r in listed), sum(r["count"] for r in listed) <= BROADCAST_CELLS
    place = F.col("lat").isNotNull() & F.col("lng").isNotNull() & (F.abs("lat") <= 90) & (F.abs("lng") <= 360)
    near = F.array(*[F.struct(F.lit(n).alias("level"), F.floor(F.col("lng") * 2.0**n).alias("ix"), F.floor(F.col("lat") * 2.0**n).alias("iy")) for n in levels])
    asked = points.filter(place).select("id", "lat", "lng", F.explode(near).alias("c")).select("id", "lat", "lng", "c.*") if levels else points.select("id", "lat", "lng", F.lit(0).alias("level"), F.lit(0).cast("long").alias("ix"), F.lit(0).cast("long").alias("iy")).limit(0)
    return asked.join(F.broadcast(cells) if few else cells, ["level", "ix", "iy"])


def regions_of(points: DataFrame, regions: DataFrame, most: int = EDGES, coarse: int = COARSE, fine: int = FINE) -> DataFrame:
    """``id, code, ordinal``: each region that holds a point of ``points(id, lat, lng)``.

    ``regions(code, ordinal, polygons)``: polygons are arrays of rings of ``[lng, lat]``, the first of them the outer one
    (``rings`` in place of ``polygons`` stands for one polygon). Edges, those of holes too, belong to the region. Regions
    with unusable geometry are passed over. Points without finite coordinates are in no region; ``points`` have unique ``id``.
    """
    edges = written(edge_rows(regions))
    cells = written(cover(edges, most, coarse, fine))
    hits = written(cell_hits(points, cells).select("id", "lat", "lng", "code", "ordinal", "inner"))
    tested = _inside(hits.filter("not inner"), ["id", "code", "ordinal"], broadcast_upto(strips(edges)))
    return hits.filter("inner").select("id", "code", "ordinal").unionByName(tested)


def assign_regions(points: DataFrame, regions: DataFrame, **cells: int) -> DataFrame:
    """``points`` with ``region_code``, the code of the first region (by ``ordinal``) that holds the point, null if none."""
    first = regions_of(points, regions, **cells).groupBy("id").agg(F.min_by("code", "ordinal").alias("region_code"))
    return points.join(first, "id", "left")
