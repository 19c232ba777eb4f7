"""Queries of grids and regions: affine fits, places of bins, point in polygon, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from sanmaru.operators import cover, grid
from sanmaru.plans.cube_queries import r6, sql6
from sanmaru.plans.registry import query
from sanmaru.session import shared_path
from sanmaru.sources import readers as R
from sanmaru.sources.bindings import cells, facilities, table, with_ctes

# Facilities on a plane in km that is nearly, but not quite, an affine image of longitude and latitude.
_PLANE = "pts AS (SELECT id, lng * 91.0::DOUBLE + lat * 0.7::DOUBLE + (id % 7) * 0.01::DOUBLE AS x, lat * 111.0::DOUBLE - lng * 0.3::DOUBLE + (id % 5) * 0.01::DOUBLE AS y, lng AS lon, lat FROM facilities)"
# Cramer's rule on moments about a fixed point.
_MOMENTS = """mo AS (SELECT count(*)::DOUBLE AS n, sum(u) AS sx, sum(v) AS sy, sum(u * u) AS sxx, sum(u * v) AS sxy, sum(v * v) AS syy, sum(lon) AS sl, sum(u * lon) AS sxl, sum(v * lon) AS syl, sum(lat) AS st, sum(u * lat) AS sxt, sum(v * lat) AS syt
  FROM (SELECT x - 11700 AS u, y - 3850 AS v, lon - 128 AS lon, lat - 35 AS lat FROM pts)),
de AS (SELECT *, n * (sxx * syy - sxy * sxy) - sx * (sx * syy - sxy * sy) + sy * (sx * sxy - sxx * sy) AS det FROM mo),
co AS (SELECT n, sx, sy, sl, st, (n * (sxl * syy - sxy * syl) - sl * (sx * syy - sxy * sy) + sy * (sx * syl - sxl * sy)) / det AS lon_x, (n * (sxx * syl - sxl * sxy) - sx * (sx * syl - sxl * sy) + sl * (sx * sxy - sxx * sy)) / det AS lon_y,
  (n * (sxt * syy - sxy * syt) - st * (sx * syy - sxy * sy) + sy * (sx * syt - sxt * sy)) / det AS lat_x, (n * (sxx * syt - sxt * sxy) - sx * (sx * syt - sxt * sy) + st * (sx * sxy - sxx * sy)) / det AS lat_y FROM de)"""
_ANCHORS = f"""bi AS (SELECT *, floor(x / 5)::BIGINT AS gx, floor(y / 5)::BIGINT AS gy FROM pts),
an AS (SELECT gx, gy, arg_min(struct_pack(id, x, y, lon, lat), ({sql6('pow(x - (gx + 0.5) * 5, 2) + pow(y - (gy + 0.5) * 5, 2)', 'd').removesuffix(' AS d')}, id)) AS a FROM bi GROUP BY ALL)"""


def _plane(spark, d):
    k, lon, lat = F.col("id"), F.col("lng"), F.col("lat")
    return facilities(spark, d).select("id", (lon * 91.0 + lat * 0.7 + (k % 7) * 0.01).alias("x"), (lat * 111.0 - lon * 0.3 + (k % 5) * 0.01).alias("y"), lon.alias("lon"), "lat")


@query("agg_affine_ls", with_ctes("facilities", f"WITH {_PLANE}, {_MOMENTS} SELECT n::BIGINT AS n, {sql6('128 + (sl - lon_x * sx - lon_y * sy) / n - lon_x * 11700 - lon_y * 3850', 'lon_0')}, {sql6('lon_x * 1000', 'lon_x')}, {sql6('lon_y * 1000', 'lon_y')}, {sql6('35 + (st - lat_x * sx - lat_y * sy) / n - lat_x * 11700 - lat_y * 3850', 'lat_0')}, {sql6('lat_x * 1000', 'lat_x')}, {sql6('lat_y * 1000', 'lat_y')} FROM co"))
def agg_affine_ls(spark, d):
    """Slopes for 1,000 km."""
    fit = grid.affine_fit(_plane(spark, d))
    return fit.select("n", *[r6(F.col(c) * (1 if c.endswith("0") else 1000), c) for c in fit.columns if c != "n"])


@query("fn_local_affine", with_ctes("facilities", f"WITH {_PLANE}, {_MOMENTS}, {_ANCHORS} SELECT gx || '_' || gy AS bin, a.id AS anchor, {sql6('a.lon + lon_x * ((gx + 0.5) * 5 - a.x) + lon_y * ((gy + 0.5) * 5 - a.y)', 'lon')}, {sql6('a.lat + lat_x * ((gx + 0.5) * 5 - a.x) + lat_y * ((gy + 0.5) * 5 - a.y)', 'lat')} FROM an, co"))
def fn_local_affine(spark, d):
    return grid.bin_places(_plane(spark, d), 5.0).select("bin", "anchor", r6("lon"), r6("lat"))


@query("agg_place_error", with_ctes("facilities", f"WITH {_PLANE}, {_MOMENTS}, {_ANCHORS} SELECT count(*) AS n, {sql6('max(abs(a.lon + lon_x * (x - a.x) + lon_y * (y - a.y) - lon))', 'worst_lon')}, {sql6('max(abs(a.lat + lat_x * (x - a.x) + lat_y * (y - a.y) - lat))', 'worst_lat')} FROM bi JOIN an USING (gx, gy), co"))
def agg_place_error(spark, d):
    return grid.place_errors(_plane(spark, d), 5.0).select("n", r6("worst_lon"), r6("worst_lat"))


# Regions round the places of cells: a diamond with a square hole, and a small square beside it.
RADIUS, HOLE, ASIDE, HALF = 0.1203, 0.0305, (0.2, 0.05), 0.0405
#: Every seventh region has an open ring and is passed over.
_BAD = "ordinal % 7 = 3"
_IN_REGION = f"""(abs(f.lng - c.lng) + abs(f.lat - c.lat) <= {RADIUS} AND NOT (abs(f.lng - c.lng) < {HOLE} AND abs(f.lat - c.lat) < {HOLE}))
  OR (abs(f.lng - c.lng - {ASIDE[0]}) <= {HALF} AND abs(f.lat - c.lat - {ASIDE[1]}) <= {HALF})"""


def _region_file(spark, d):
    """Those regions as a GeoJSON collection; a row for each cell, 25 at any scale."""
    x, y = F.col("lng"), F.col("lat")
    ring = lambda *ps: F.array(*[F.array(x + a, y + b) for a, b in (*ps, ps[0])])
    square = lambda h, a=0.0, b=0.0: ring((a - h, b - h), (a + h, b - h), (a + h, b + h), (a - h, b + h))
    diamond = ring((-RADIUS, 0.0), (0.0, -RADIUS), (RADIUS, 0.0), (0.0, RADIUS))
    outer = F.when(F.expr(_BAD), F.slice(diamond, 1, 4)).otherwise(diamond)
    body = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(outer, square(HOLE)), F.array(square(HALF, *ASIDE))).alias("coordinates")))
    feature = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct("code", F.col("ordinal").cast("string").alias("ordinal"))), F.lit(',"geometry":'), body, F.lit("}"))
    path = shared_path(spark, "regions")
    whole = cells(spark, d).agg(F.array_join(F.array_sort(F.collect_list(feature)), ",").alias("f"))
    whole.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "f", F.lit("]}")).alias("value")).coalesce(1).write.text(path)
    return path


def _regions(spark, d):
    p = F.col("properties")
    return R.read_geojson(spark, _region_file(spark, d)).select(p["code"].alias("code"), p["ordinal"].cast("int").alias("ordinal"), "polygons")


@query("join_pip_first", with_ctes("facilities cells", f"WITH h AS (SELECT f.id, arg_min(c.code, c.ordinal) AS region_code FROM facilities f JOIN cells c ON NOT ({_BAD}) AND ({_IN_REGION}) GROUP BY f.id) SELECT id, region_code FROM facilities LEFT JOIN h USING (id)"))
def join_pip_first(spark, d):
    return cover.assign_regions(facilities(spark, d).select("id", "lat", "lng"), _regions(spark, d)).select("id", "region_code")


@query("join_pip_bbox", with_ctes("facilities cells", f"SELECT c.code, count(*) AS facilities, min(f.id) AS first FROM facilities f JOIN cells c ON NOT ({_BAD}) AND ({_IN_REGION}) GROUP BY c.code"))
def join_pip_bbox(spark, d):
    """All regions that hold a facility, not only the first, after the filter by cells of the regions' bounding boxes."""
    hits = cover.regions_of(facilities(spark, d).select("id", "lat", "lng"), _regions(spark, d))
    return hits.groupBy("code").agg(F.count(F.lit(1)).alias("facilities"), F.min("id").alias("first"))


# A grid of 30 x 30 places: orders are summed by the grid of their customer, regions have totals of line items.
_GRID = "g AS (SELECT g AS gid, 127.53::DOUBLE + (g % 30) * 0.06::DOUBLE AS lng, 34.53::DOUBLE + (g // 30) * 0.045::DOUBLE AS lat FROM (SELECT DISTINCT c_custkey % 900 AS g FROM customer))"
_REGION_OF = f"r AS (SELECT gid, arg_min(c.code, c.ordinal) AS code FROM g f JOIN cells c ON NOT ({_BAD}) AND ({_IN_REGION}) GROUP BY gid)"
_GRID_SIDES = f"""{_GRID}, {_REGION_OF},
fi AS (SELECT o_custkey % 900 AS gid, sum(o_totalprice) AS value, count(*) AS rows FROM orders GROUP BY 1),
fr AS (SELECT code, sum(value) AS grid, count(*) AS grids FROM fi LEFT JOIN r USING (gid) WHERE gid % 97 > 0 GROUP BY 1),
tt AS (SELECT code, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) * CASE WHEN substr(code, 10) >= '5' THEN 1.2 ELSE 1 END AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN r ON o_custkey % 900 = gid WHERE gid % 11 > 0 GROUP BY code)"""


def _grids(spark, d):
    """Sums of orders by grid; grids divisible by 97 have no place."""
    gid = F.col("gid")
    centroids = table(spark, d, "customer").select((F.col("c_custkey") % 900).alias("gid")).distinct()
    centroids = centroids.withColumn("lng", 127.53 + (gid % 30) * 0.06).withColumn("lat", 34.53 + F.floor(gid / 30) * 0.045)
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 900).alias("gid"), F.col("o_totalprice").alias("value"))
    return grid.grid_sums(rows, centroids.filter("gid % 97 > 0")), centroids


def _two_grains(spark, d):
    """Grid sums of orders, and totals of regions made from line items that lack some customers."""
    grids, centroids = _grids(spark, d)
    regions = _regions(spark, d)
    home = cover.assign_regions(centroids.select(F.col("gid").alias("id"), "lat", "lng"), regions).filter("region_code is not null and id % 11 > 0")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("v"))
    owned = lines.join(table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 900).alias("id")), "o_orderkey").groupBy("id").agg(F.sum("v").alias("v"))
    factor = F.when(F.substring(F.col("code"), 10, 1) >= "5", 1.2).otherwise(1.0)
    totals = owned.join(home.select("id", F.col("region_code").alias("code")), "id").groupBy("code").agg(F.sum("v").alias("v")).select("code", (F.col("v") * factor).alias("total"))
    return grids, totals, regions


@query("agg_grid_verify", with_ctes("cells", f"WITH {_GRID_SIDES} SELECT code, floor(grid / total * 1e4 + 0.5) / 1e4 AS ratio FROM fr JOIN tt USING (code) WHERE NOT (grid / total > 0.9 AND grid / total < 1.1) ORDER BY abs(1 - grid / total) DESC, code LIMIT 8"))
def agg_grid_verify(spark, d):
    """The eight regions that fit least."""
    ratio = F.floor(F.col("ratio") * 1e4 + 0.5) / 1e4
    return grid.worst(grid.reconcile(*_two_grains(spark, d))).select("code", ratio.alias("ratio"))


@query("job_grid_verify", with_ctes("cells", f"""WITH {_GRID_SIDES}, b AS (SELECT * FROM fr FULL JOIN tt USING (code))
SELECT count(grid / total) FILTER (code IS NOT NULL) AS compared, count(*) FILTER (grid / total > 0.9 AND grid / total < 1.1) AS fitting, coalesce(sum(grids) FILTER (code IS NULL), 0)::BIGINT AS outside_grids,
  floor(coalesce(sum(grid) FILTER (code IS NULL), 0) + 0.5)::BIGINT AS outside_value, (SELECT coalesce(sum(rows), 0) FROM fi WHERE gid % 97 = 0)::BIGINT AS unplaced_rows, floor(sum(grid) FILTER (code IS NOT NULL) + 0.5)::BIGINT AS grid_total, floor(sum(total) + 0.5)::BIGINT AS region_total FROM b"""))
def job_grid_verify(spark, d):
    whole = lambda c: F.floor(F.col(c) + 0.5).alias(c)
    row = grid.reconciliation(*_two_grains(spark, d))
    return row.select("compared", "fitting", "outside_grids", whole("outside_value"), "unplaced_rows", whole("grid_total"), whole("region_total"))
