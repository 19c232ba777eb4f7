"""Queries of boundary checks, facility records, snapshots and GeoJSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from sanmaru.functions import shapes as P
from sanmaru.functions.geo import in_polygon
from sanmaru.functions.numeric import half_up
from sanmaru.operators import boundary as B
from sanmaru.operators import crossings as E
from sanmaru.plans.cube_queries import r6, sql6
from sanmaru.plans.registry import query
from sanmaru.session import shared_path
from sanmaru.sources import readers as R
from sanmaru.sources import sinks as S
from sanmaru.sources.bindings import cells, facilities, region_series, table, with_ctes


def _pad(n):
    return lambda c: F.lpad(c.cast("string"), n, "0")


def squares(spark, d):
    """A square of a hundredth of a degree for each facility, with a hole in every third one."""
    ring = lambda a, b: F.array(*[F.array(F.col("lng") + x, F.col("lat") + y) for x, y in ((a, a), (b, a), (b, b), (a, b), (a, a))])
    outer, hole = ring(0.0, 0.01), ring(0.004, 0.006)
    return facilities(spark, d).select("id", "lat", "lng", F.array(F.when(F.col("id") % 3 == 0, F.array(outer, hole)).otherwise(F.array(outer))).alias("polygons"))


def _properties(bad):
    code = _pad(8)(F.col("id"))
    pairs = {
        "adm_nm": F.when(bad == 3, F.lit("서울특별시 가동")).otherwise(F.concat(F.lit("경상남도 "), F.col("id"))), "adm_cd": F.when(bad == 2, F.substring(code, 2, 7)).otherwise(code),
        "adm_cd2": F.concat(code, F.lit("00")), "sgg": F.when(bad == 1, F.lit(" ")).otherwise(F.lit("48121")), "sido": F.lit("48"), "sidonm": F.lit("경상남도"), "sggnm": F.lit("창원시"),
    }
    return F.create_map(*[v for k, c in pairs.items() for v in (F.lit(k), c)])


@query("fn_required_props", with_ctes("facilities", "SELECT id, CASE id % 4 WHEN 1 THEN 'blank sgg' WHEN 2 THEN 'adm_cd' WHEN 3 THEN 'province' END AS problem FROM facilities"))
def fn_required_props(spark, d):
    return facilities(spark, d).select("id", B.property_problem(_properties(F.col("id") % 4)).alias("problem"))


@query("fn_crs", "SELECT s_suppkey AS id, s_suppkey % 3 < 2 AS fine FROM supplier")
def fn_crs(spark, d):
    k = F.col("s_suppkey")
    name = F.when(k % 3 == 0, "EPSG:4326").when(k % 3 == 1, "urn:ogc:def:crs:OGC:1.3:CRS84").when(k % 6 == 2, "EPSG:5179")
    return table(spark, d, "supplier").select(k.alias("id"), B.crs_supported(name).alias("fine"))


_SEG = "s AS (SELECT o_orderkey AS id, o_orderkey % 7 AS a_x, o_orderkey % 5 AS a_y, o_orderkey % 3 AS b_x, o_orderkey % 11 AS b_y, o_custkey % 6 AS c_x, o_custkey % 4 AS c_y, o_custkey % 9 AS d_x, o_custkey % 8 AS d_y FROM orders)"


def _side(a, b, p):
    return f"sign(({b}_x - {a}_x) * ({p}_y - {a}_y) - ({b}_y - {a}_y) * ({p}_x - {a}_x))"


def _touches(a, b, p):
    return f"({_side(a, b, p)} = 0 AND {p}_x BETWEEN least({a}_x, {b}_x) AND greatest({a}_x, {b}_x) AND {p}_y BETWEEN least({a}_y, {b}_y) AND greatest({a}_y, {b}_y))"


@query("fn_segments", f"WITH {_SEG} SELECT id, ({_side('a', 'b', 'c')} * {_side('a', 'b', 'd')} < 0 AND {_side('c', 'd', 'a')} * {_side('c', 'd', 'b')} < 0) OR {_touches('a', 'b', 'c')} OR {_touches('a', 'b', 'd')} OR {_touches('c', 'd', 'a')} OR {_touches('c', 'd', 'b')} AS meet FROM s")
def fn_segments(spark, d):
    """Crossing, touching and collinear segments meet."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    segment = lambda *v: F.struct(*[(k % n).cast("double").alias(name) for (k, n), name in zip(v, ("x1", "y1", "x2", "y2"), strict=True)])
    rows = table(spark, d, "orders").select(o.alias("id"), segment((o, 7), (o, 5), (o, 3), (o, 11)).alias("e"), segment((c, 6), (c, 4), (c, 9), (c, 8)).alias("f"))
    return rows.select("id", P.meet(F.col("e"), F.col("f")).alias("meet"))


@query("fn_geom_validate", with_ctes("facilities", f"SELECT count(*)::INT AS feature_count, array_to_string(list_sort(list(lpad(id::VARCHAR, 8, '0') || '00')), ' ') AS codes, {sql6('min(lng)', 'west')}, {sql6('min(lat)', 'south')}, {sql6('max(lng) + 0.01', 'east')}, {sql6('max(lat) + 0.01', 'north')} FROM facilities"))
def fn_geom_validate(spark, d):
    features = squares(spark, d).withColumn("properties", _properties(F.lit(0)))
    checked = B.validate_boundaries(features, "EPSG:4326", least=5)
    return checked.select("feature_count", F.array_join("codes", " ").alias("codes"), r6("west"), r6("south"), r6("east"), r6("north"))


def _collection(spark, d):
    """Cells as one GeoJSON document (25 features at any scale): squares as polygons or multi-polygons."""
    x, y = F.col("lng"), F.col("lat")
    ring = F.array(*[F.array(x + a, y + b) for a, b in ((0.0, 0.0), (0.1, 0.0), (0.1, 0.1), (0.0, 0.0))])
    geometry = lambda kind, body: F.to_json(F.struct(F.lit(kind).alias("type"), body.alias("coordinates")))
    shape = F.when(F.col("ordinal") % 2 == 0, geometry("Polygon", F.array(ring))).otherwise(geometry("MultiPolygon", F.array(F.array(ring))))
    feature = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct("code", "name")), F.lit(',"geometry":'), shape, F.lit("}"))
    whole = cells(spark, d).agg(F.array_join(F.array_sort(F.collect_list(feature)), ",").alias("f"))
    path = shared_path(spark, "geojson")
    whole.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "f", F.lit("]}")).alias("value")).coalesce(1).write.text(path)
    return path


@query("src_geojson", with_ctes("cells", f"SELECT code, name, 1::INT AS parts, 4::INT AS corners, {sql6('lng', 'west')} FROM cells"))
def src_geojson(spark, d):
    f = R.read_geojson(spark, _collection(spark, d))
    ring = F.col("polygons")[0][0]
    return f.select(F.element_at("properties", "code").alias("code"), F.element_at("properties", "name").alias("name"), F.size("polygons").alias("parts"), F.size(ring).alias("corners"), r6(F.array_min(F.transform(ring, lambda p: p[0])), "west"))


@query("sink_bnd_meta", with_ctes("cells", "SELECT '20260101' AS version, 'EPSG:4326' AS crs, 64::INT AS sha_length, count(*)::INT AS feature_count, array_to_string(list_sort(list(code)), ' ') AS codes FROM cells"))
def sink_bnd_meta(spark, d):
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(_collection(spark, d))
    meta = S.boundary_metadata(cells(spark, d).select("code"), files, "20260101")
    return meta.select("version", "crs", F.length("sha256").alias("sha_length"), "feature_count", F.array_join("codes", " ").alias("codes"))


@query("sink_grid_geojson", with_ctes("facilities", f"SELECT id, CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END::INT AS rings, {sql6('lng + 0.01', 'east')} FROM facilities"))
def sink_grid_geojson(spark, d):
    """Features written one to a line and read again."""
    path = shared_path(spark, "features")
    S.write_features(squares(spark, d).select(F.create_map(F.lit("id"), F.col("id").cast("string")).alias("properties"), "polygons"), path)
    back = spark.read.schema("properties map<string, string>, geometry struct<coordinates: array<array<array<array<double>>>>>").json(path)
    polygon = F.col("geometry.coordinates")[0]
    return back.select(F.element_at("properties", "id").cast("long").alias("id"), F.size(polygon).alias("rings"), r6(F.array_max(F.transform(polygon[0], lambda p: p[0])), "east"))


@query("src_snapshot_json", with_ctes("series", "SELECT 'live' AS mode, code, count(*) FILTER (month_no BETWEEN 24006 AND 24018)::INT AS months FROM series GROUP BY 2"))
def src_snapshot_json(spark, d):
    """A snapshot (25 regions and 13 months at any scale) written, read by its schema and checked."""
    rows = region_series(spark, d).groupBy("code").agg(F.array_sort(F.collect_list("month")).alias("months"))
    months = F.array(*[F.lit(f"{2000 + m // 12}-{m % 12 + 1:02d}") for m in range(6, 19)])
    path = shared_path(spark, "snapshot")
    rows.agg(F.collect_list(F.struct("code", F.size("months").alias("months"))).alias("regions")).select(F.lit("live").alias("mode"), months.alias("months"), "regions").coalesce(1).write.json(path)
    docs = spark.read.schema("mode string, months array<string>, regions array<struct<code:string,months:int>>").json(path)
    return B.check_snapshot(docs).select("mode", F.explode("regions").alias("r")).select("mode", "r.code", "r.months")


@query("prj_facility_hira", with_ctes("facilities", "WITH t AS (SELECT id, name, lat, lng, CASE id % 6 WHEN 0 THEN '종합병원' WHEN 1 THEN '병원' WHEN 2 THEN '치과의원' WHEN 3 THEN '약국' WHEN 4 THEN '의원' END AS type FROM facilities) SELECT CASE WHEN id % 2 = 0 THEN 'Y' || id ELSE printf('hira-%s-%.5f-%.5f-%d', name, lat, lng, id) END AS id, name, type, " + f"{sql6('lat', 'lat')}, {sql6('lng', 'lng')} FROM t WHERE type IS NOT NULL AND lat BETWEEN 34.2 AND 36.2 AND lng BETWEEN 127.3 AND 129.8"))
def prj_facility_hira(spark, d):
    k = F.col("id")
    label = F.when(k % 6 == 0, "상급종합병원").when(k % 6 == 1, "한방병원").when(k % 6 == 2, "치과").when(k % 6 == 4, " 의원 ")
    rows = facilities(spark, d).select(
        F.when(k % 2 == 0, F.concat(F.lit("Y"), k)).alias("ykiho"), F.col("name").alias("yadmNm"), label.alias("clCdNm"), F.when(k % 6 == 3, "81").otherwise("99").alias("clCd"),
        F.col("lng").cast("string").alias("XPos"), F.col("lat").cast("string").alias("YPos"), F.lit("").alias("addr"), F.lit(None).cast("string").alias("telno"), k.alias("index"),
    )
    return B.register_facilities(rows).select("id", "name", "type", r6("lat"), r6("lng"))


@query("prj_facilities", with_ctes("facilities", f"SELECT id::VARCHAR AS id, name, CASE WHEN id % 2 = 0 THEN '약국' ELSE '한의원' END AS type, code, {sql6('lat', 'lat')}, {sql6('lng', 'lng')}, CASE WHEN id % 3 = 0 THEN 2 ELSE 0 END::INT AS specialties FROM facilities"))
def prj_facilities(spark, d):
    """Records of two shapes."""
    k, text = F.col("id"), lambda c: F.col(c).cast("string")
    one = {"id": text("id"), "name": F.col("name"), "type": F.lit("동네 약국"), "adm_cd2": F.col("code"), "adm_nm": F.lit("가동"), "lat": text("lat"), "lng": text("lng")}
    two = {"ykiho": text("id"), "yadmNm": F.col("name"), "clCdNm": F.lit("한의원"), "admmCd": F.col("code"), "admmNm": F.lit("나동"), "YPos": text("lat"), "XPos": text("lng")}
    record = lambda m: F.create_map(*[v for n, c in {**m, "dgsbjtCdNm": F.when(k % 3 == 0, " eyes, ,ears").otherwise(" ")}.items() for v in (F.lit(n), c)])
    rows = facilities(spark, d).select(F.when(k % 2 == 0, record(one)).otherwise(record(two)).alias("record"))
    return B.strict_facilities(rows).select("id", "name", "type", "code", r6("lat"), r6("lng"), F.coalesce(F.size("specialties"), F.lit(0)).alias("specialties"))


@query("prj_live_flag", "SELECT s_suppkey AS id, s_suppkey % 4 < 2 AS live FROM supplier")
def prj_live_flag(spark, d):
    """Notes on births don't count; a base snapshot of households does."""
    k = F.col("s_suppkey")
    note = F.when(k % 4 == 0, "출생·사망 값은 합성값입니다").when(k % 4 == 1, "인구는 실측").when(k % 4 == 2, "세대: 나머지는 기준 스냅샷").otherwise("없음")
    return table(spark, d, "supplier").select(k.alias("id"), B.population_is_live(F.when(k % 4 == 3, "demo").otherwise("live"), F.array(note)).alias("live"))


_FAULTS = "CASE WHEN id % 12 = 1 THEN 'open' WHEN id % 12 = 2 THEN 'crossing' WHEN id % 12 = 3 THEN 'hole' WHEN id % 12 = 4 THEN 'hole' WHEN id % 12 = 5 THEN 'bounds' WHEN id % 12 = 6 THEN 'empty' WHEN id % 12 = 7 THEN 'short' END"


def _shapes(spark, d):
    """Rings of 16 corners round facilities, most with a hole, some with a fault; those of id % 12 = 4 have a hole that touches the ring."""
    at = lambda x, y: F.array(F.col("lng") + x, F.col("lat") + y)
    ring = lambda ps: F.array(*[at(x, y) for x, y in [*ps, ps[0]]])
    comb = [(0.0, 0.0), (0.016, 0.0), (0.016, 0.01), (0.0145, 0.01), (0.0145, 0.004), (0.012, 0.004), (0.012, 0.01), (0.0105, 0.01), (0.0105, 0.004), (0.008, 0.004), (0.008, 0.01), (0.0065, 0.01), (0.0065, 0.004), (0.004, 0.004), (0.004, 0.01), (0.0, 0.01)]
    tied = [*comb[:4], (0.0105, 0.0055), (0.0145, 0.004), (0.012, 0.01), *comb[7:]]  # one edge cuts through the next tooth
    box = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    k = F.col("id") % 12
    outer = F.when(k == 1, F.slice(ring(comb), 1, 16)).when(k == 2, ring(tied)).when(k == 7, F.slice(ring(comb), 1, 3)).when(k == 5, F.transform(ring(comb), lambda p: F.array(p[0] + 5.0, p[1]))).otherwise(ring(comb))
    hole = F.when(k == 3, ring(box(0.005, 0.006, 0.001))).when(k == 4, ring([(0.001, 0.0), (0.003, 0.002), (0.001, 0.002)])).otherwise(F.when(k == 5, F.transform(ring(box(0.001, 0.001, 0.001)), lambda p: F.array(p[0] + 5.0, p[1]))).otherwise(ring(box(0.001, 0.001, 0.001))))
    polygons = F.when(k == 6, F.array().cast("array<array<array<array<double>>>>")).when(k == 0, F.array(F.array(outer))).otherwise(F.array(F.array(outer, hole)))
    return facilities(spark, d).select("id", polygons.alias("polygons"))


@query("fn_geometry_faults", with_ctes("facilities", f"SELECT id, {_FAULTS} AS problem FROM facilities"))
def fn_geometry_faults(spark, d):
    return E.geometry_problems(_shapes(spark, d))


@query("job_validate_boundary", with_ctes("facilities", f"""WITH f AS (SELECT id, lpad(id::VARCHAR, 8, '0') || '00' AS code, {_FAULTS} AS problem FROM facilities)
SELECT 'geometry' AS "check", code, problem AS detail FROM f WHERE problem IS NOT NULL
UNION ALL SELECT 'only in metadata', '9' || substr(code, 2), NULL FROM f WHERE id % 20 = 0 UNION ALL SELECT 'only in boundary', code, NULL FROM f WHERE id % 20 = 0
UNION ALL SELECT 'count', NULL, count(*)::VARCHAR FROM f UNION ALL SELECT 'crs', NULL, 'EPSG:5179'"""))
def job_validate_boundary(spark, d):
    """Features written as GeoJSON lines and read again; their metadata has other codes for some, another count and another system."""
    path, code = shared_path(spark, "boundary"), F.concat(_pad(8)(F.col("id")), F.lit("00"))
    S.write_features(_shapes(spark, d).select(F.create_map(F.lit("adm_cd2"), code).alias("properties"), "polygons"), path)
    back = spark.read.schema("properties map<string, string>, geometry struct<coordinates: array<array<array<array<double>>>>>").json(path)
    features = back.select(F.element_at("properties", "adm_cd2").alias("code"), F.col("geometry.coordinates").alias("polygons"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    listed = facilities(spark, d).select(F.when(F.col("id") % 20 == 0, F.concat(F.lit("9"), F.expr("substr(lpad(id, 8, '0') || '00', 2)"))).otherwise(code).alias("code"))
    metadata = S.boundary_metadata(listed, files, "20260101").withColumn("crs", F.lit("EPSG:5179")).withColumn("feature_count", F.col("feature_count") + 1)
    return E.boundary_report(features, "EPSG:4326", files, metadata)


_RECT = "radians({w}) * (sin(radians(lat + {b})) - sin(radians(lat + {a})))"
_COMB = " + ".join([_RECT.format(w=0.016, a=0, b=0.004), *[_RECT.format(w=w, a=0.004, b=0.01) for w in (0.004, 0.0015, 0.0015, 0.0015)]])


@query("fn_area_point", with_ctes("facilities", f"""SELECT id, floor(6371.0088 * 6371.0088 * ({_COMB} - CASE WHEN id % 2 = 1 THEN {_RECT.format(w=0.0008, a=0.003, b=0.0093)} ELSE 0 END) * 1e4 + 0.5) / 1e4 AS km2,
  floor((lng + CASE WHEN id % 2 = 1 THEN 0.0026 ELSE 0.002 END) * 1e6 + 0.5) / 1e6 AS lng, floor((lat + CASE WHEN id % 2 = 1 THEN 0.00665 ELSE 0.007 END) * 1e6 + 0.5) / 1e6 AS lat, true AS inside FROM facilities"""))
def fn_area_point(spark, d):
    """Area and an inner place of combs, every other one with a hole under the scanline."""
    corners = [(0.0, 0.0), (0.016, 0.0), (0.016, 0.01), (0.0145, 0.01), (0.0145, 0.004), (0.012, 0.004), (0.012, 0.01), (0.0105, 0.01), (0.0105, 0.004), (0.008, 0.004), (0.008, 0.01), (0.0065, 0.01), (0.0065, 0.004), (0.004, 0.004), (0.004, 0.01), (0.0, 0.01)]
    ring = lambda ps: F.array(*[F.array(F.col("lng") + x, F.col("lat") + y) for x, y in [*ps, ps[0]]])
    hole = ring([(0.0004, 0.003), (0.0012, 0.003), (0.0012, 0.0093), (0.0004, 0.0093)])
    rows = facilities(spark, d).select("id", F.when(F.col("id") % 2 == 1, F.array(ring(corners), hole)).otherwise(F.array(ring(corners))).alias("rings"))
    rows = rows.select("id", "rings", half_up(P.polygon_area_km2(F.col("rings")), 4).alias("km2"), P.interior_point(F.col("rings")).alias("p"))
    return rows.select("id", "km2", r6("p.lng", "lng"), r6("p.lat", "lat"), in_polygon(F.col("p.lng"), F.col("p.lat"), F.col("rings")).alias("inside"))
