import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sanmaru.functions.geo import EARTH_KM, haversine_km
from sanmaru.operators import access as A


def km(a, b):
    (p, q), (r, s) = (tuple(map(math.radians, x)) for x in (a, b))
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return 2 * EARTH_KM * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def points(spark, n, seed, name):
    rng = random.Random(seed)
    rows = [(f"{name}{i}", rng.uniform(34, 36), rng.uniform(127, 130)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "code string, lat double, lng double")


def test_haversine(spark):
    rows = spark.createDataFrame([(35.0, 128.0, 35.0 + 1 / 111.195, 128.0), (0.0, 0.0, 0.0, 180.0)], "a double, b double, c double, d double")
    got = [r.km for r in rows.select(haversine_km(*map(F.col, "abcd")).alias("km")).collect()]
    assert abs(got[0] - 1) < 1e-3 and abs(got[1] - math.pi * EARTH_KM) < 1e-6


def test_nearest_and_radius_match_all_pairs(spark):
    origins, o = points(spark, 40, 1, "o")
    places, p = points(spark, 60, 2, "p")
    far = [("far", -40.0, -70.0)]
    o = o.unionByName(spark.createDataFrame(far, o.schema))
    near = {r.code: r.nearest_km for r in A.nearest(o, p).collect()}
    within = {r.code: r.within for r in A.within_radius(o, p, 25).collect()}
    for c, lat, lng in origins + far:
        d = [km((lat, lng), (y, x)) for _, y, x in places]
        assert abs(near[c] - min(d)) < 1e-6 and within.get(c, 0) == sum(v <= 25 for v in d)


def test_no_facilities(spark):
    _, o = points(spark, 3, 1, "o")
    got = A.access(o, o.limit(0), 2).collect()
    assert {(r.nearest_km, r.within, r.own) for r in got} == {(None, 0, 0)}


def test_opening_hours(spark):
    rows = spark.createDataFrame([(1, {"monday": "05:30-12:00"}), (2, {"monday": "09:00-20:00"}), (3, {"monday": "10:00-02:00"}), (4, {"monday": "09:00-18:00", "saturday": ""}), (5, {"sunday": "09:00-12:00"}), (6, None)], "id int, hours map<string,string>")
    got = {r.id: (r.n, r.w) for r in rows.select("id", A.night_open(F.col("hours")).alias("n"), A.weekend_open(F.col("hours")).alias("w")).collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (True, False), 4: (False, False), 5: (False, True), 6: (False, False)}


def test_radius_near_poles_and_the_date_line_and_of_zero(spark):
    rng = random.Random(5)
    spots = [(max(-90.0, rng.choice([89.9, 89.0, -89.95, 0.0, 45.0, 60.0]) + rng.uniform(-0.3, 0.05)), rng.choice([179.9, -179.95, 0.0, 90.0]) + rng.uniform(-0.05, 0.05)) for _ in range(160)]
    o = spark.createDataFrame([(str(i), a, b) for i, (a, b) in enumerate(spots[:80])] + [("same", *spots[100])], "code string, lat double, lng double")
    p = spark.createDataFrame(spots[80:], "lat double, lng double")
    from sanmaru.functions.geo import haversine_km
    from pyspark.sql import functions as F

    far = o.crossJoin(p.select(F.col("lat").alias("a"), F.col("lng").alias("b"))).withColumn("km", haversine_km(F.col("lat"), F.col("lng"), F.col("a"), F.col("b"))).collect()
    for km in (0, 3, 40, 400):
        want = Counter(r.code for r in far if r.km <= km)
        assert {r.code: r.within for r in A.within_radius(o, p, km).collect()} == dict(want)
    got = {r.code: r.nearest_km for r in A.nearest(o, p, 5.0).collect()}
    assert all(abs(got[c] - min(r.km for r in far if r.code == c)) < 1e-9 for c in got)
    for km in (-1, float("inf"), float("nan")):
        with pytest.raises(ValueError):
            A.within_radius(o, p, km)


def test_edges_belong_to_polygons(spark):
    square = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
    hole = [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0], [1.0, 1.0]]
    from pyspark.sql import functions as F
    from sanmaru.functions.geo import in_polygon

    points = {(0, 0): True, (4, 4): True, (4, 2): True, (2, 4): True, (3, 3): True, (1.5, 1.5): False, (2, 1.5): True, (1, 1): True, (4.1, 2): False, (5, 4): False}
    rows = spark.createDataFrame([(float(x), float(y), [square, hole]) for x, y in points], "x double, y double, rings array<array<array<double>>>")
    assert {(r.x, r.y): r.i for r in rows.select("x", "y", in_polygon(F.col("x"), F.col("y"), F.col("rings")).alias("i")).collect()} == points


def test_rings_meet_where_they_cross_touch_or_overlap(spark):
    from pyspark.sql import functions as F
    from sanmaru.functions.shapes import rings_intersect

    ring = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    cases = [(ring(0.0, 0.0, 2.0), ring(1.0, 1.0, 2.0), True), (ring(0.0, 0.0, 2.0), ring(2.0, 0.0, 1.0), True), (ring(0.0, 0.0, 2.0), ring(2.0, 2.0, 1.0), True), (ring(0.0, 0.0, 4.0), ring(1.0, 1.0, 1.0), False), (ring(0.0, 0.0, 1.0), ring(3.0, 0.0, 1.0), False)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a array<array<double>>, b array<array<double>>")
    assert {r.i: r.m for r in df.select("i", rings_intersect(F.col("a"), F.col("b")).alias("m")).collect()} == {i: m for i, (_, _, m) in enumerate(cases)}
