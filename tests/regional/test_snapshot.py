"""The snapshot and its ledger, intents as one plan, and places inside polygons."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sanmaru.functions.geo import in_polygon
from sanmaru.functions.shapes import interior_point, polygon_area_km2
from sanmaru.operators import dispatch as D
from sanmaru.operators import snapshot as N
from sanmaru.operators import tools as T

REGIONS = [("a", 2.0), ("b", 4.0), ("c", 5.0)]


def feeds(spark, drop=(), blank=(), months=range(100, 115)):
    """Five feeds with two rows for each region and month; ``drop`` and ``blank`` name (feed, code, month)."""
    out = {}
    for f, values in N.FEEDS.items():
        rows = [(c, m, *[None if (f, c, m) in blank and part else i + m + part for i in range(len(values))]) for c in "abcz" for m in months for part in (0, 1) if (f, c, m) not in drop]
        out[f] = spark.createDataFrame(rows, "code string, month_no int, " + ", ".join(f"{v} long" for v in values))
    return out


def run(spark, regions=REGIONS, **faults):
    rows, ledger = N.normalize(spark.createDataFrame(regions, "code string, area_km2 double"), feeds(spark, **faults))
    return {(r.code, r.month_no): r for r in rows.collect()}, {(r.fault, r.feed, r.code, r.month_no) for r in ledger.collect()}


def test_faultless_feeds(spark):
    rows, ledger = run(spark, drop=[("one_person", "a", 110), ("births", "b", 101)])
    assert ledger == set() and set(rows) == {(c, m) for c in "abc" for m in range(102, 115)}
    r = rows["b", 110]
    assert (r.population, r.households, r.density, r.elderly, r.births, r.natural_change, r.one_person) == (221, 223, 221 / 4, 225, 221, 0, 221)
    assert rows["a", 110].one_person is None


def test_every_fault_is_in_the_ledger(spark):
    drop = [("births", "b", 110), ("ages", "b", 110), *[("deaths", c, 101) for c in "abcz"]]
    rows, ledger = run(spark, regions=[*REGIONS, ("c", 5.0), ("d", 0.0)], drop=drop, blank=[("resident", "a", 105), ("resident", "a", 100)])
    assert {x for x in ledger if x[2] != "d"} == {("missing", "births", "b", 110), ("missing", "ages", "b", 110), ("blank", "resident", "a", 105), ("repeated", None, "c", None)}
    assert ("area", None, "d", None) in ledger and ("missing", "deaths", "d", 114) in ledger and rows == {}


def test_months_must_follow_one_another(spark):
    rows, ledger = run(spark, drop=[("deaths", c, 108) for c in "abcz"])
    assert rows == {} and {x for x in ledger if x[0] == "months"} == {("months", None, None, 107)}
    rows, ledger = run(spark, months=range(100, 105))
    assert rows == {} and ("months", None, None, None) in ledger


SCHEMA = "id int, tool string, level string, radius_km double, limit int, direction string, regions array<string>"


def model(spark):
    rng = random.Random(3)
    cells = [(f"0000{s}0000{n}", f"P{s} town{n}", 35.0 + s / 10 + n / 100, 128.0 + n / 50, 3.0 + n) for s in range(2) for n in range(4)]
    series = [(c[0], m, rng.randrange(50, 99), rng.randrange(20, 40), rng.randrange(5, 20), 5, 3, rng.randrange(9), rng.randrange(9), 20) for c in cells for m in (0, 12)]
    places = [(i, "clinic", cells[i % 8][0], 35.0 + rng.random() / 4, 128.0 + rng.random() / 10) for i in range(60)]
    return (
        spark.createDataFrame(series, "code string, month_no int, population long, households long, elderly long, youth long, one_person long, births long, deaths long, working long"),
        spark.createDataFrame(cells, "code string, name string, lat double, lng double, area_km2 double"),
        spark.createDataFrame(places, "id int, type string, code string, lat double, lng double"),
    )


def test_intents_equal_the_tools_one_by_one(spark):
    series, cells, facilities = model(spark)
    intents = [(i, t, None, None, 600, None, None) for i, t in enumerate(D.TOOLS)] + [(100, "countFacilitiesWithinRadius", "dong", 3.0, 2, "descending", None), (101, "rankPopulationSize", "sgg", None, None, "ascending", []), (102, "rankPopulationSize", None, None, 3, None, ["P1"]), (103, "rankBirthCount", "dong", 1.5, 1, None, ["P0 town2", "0000100001"])]
    table = spark.createDataFrame(intents, SCHEMA)
    rows, faults = D.run_intents(table, series, cells, facilities, 12)
    assert faults.collect() == []
    got = {}
    for r in rows.orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.code, r.score, r.level))
    single = {**{t: f(series, 12) for t, f in D.SERIES_TOOLS.items()}, "rankPopulationDensity": T.density_ranking(series, cells, 12), "nearestFacilityDistance": T.nearest_ranking(cells, facilities), "countFacilitiesWithinRadius": T.radius_ranking(cells, facilities, 2.0)}
    for i, tool in enumerate(D.TOOLS):
        want = [(r.code, r.score, "행정동") for r in single[tool].orderBy("rank", "code").collect() if r.score is not None]
        assert got.get(i, []) == want, tool
    three = {r.code: r.score for r in T.radius_ranking(cells, facilities, 3.0).collect()}
    assert [x[1] for x in got[100]] == sorted(three.values(), reverse=True)[:2]
    assert [(c, level) for c, _, level in got[101]] and {x[2] for x in got[101]} == {"시군구"} and len(got[101]) == 2 and got[101][0][1] <= got[101][1][1]
    assert len(got[102]) == 3 and all(c.startswith("00001") for c, _, _ in got[102]) and len(got[103]) == 1


def test_faults_of_intents(spark):
    series, cells, facilities = model(spark)
    bad = [(1, "rankWeather", None, None, None, None, None), (2, "rankBirthCount", "city", 0.5, 601, "up", ["x" * 51]), (3, "rankBirthCount", None, float("nan"), 0, None, ["x"] * 11), (4, None, None, 3.5, None, None, [None]), (5, "rankBirthCount", None, None, None, None, None)]
    rows, faults = D.run_intents(spark.createDataFrame(bad, SCHEMA), series, cells, facilities, 12)
    got = {}
    for r in faults.collect():
        got.setdefault(r.id, set()).add(r.fault)
    assert got == {1: {"unknown tool"}, 2: {"unknown level", "radius", "limit", "direction", "regions"}, 3: {"radius", "limit", "regions"}, 4: {"unknown tool", "radius", "regions"}}
    assert {r.id for r in rows.collect()} == {5}
    rows, faults = D.run_intents(spark.createDataFrame(bad[4:], SCHEMA), series, cells.union(cells.limit(1)), facilities, 12)
    assert rows.collect() == [] and [r.fault.startswith("repeated code") for r in faults.collect()] == [True]


def test_inner_places_of_concave_rings_with_holes(spark):
    rng = random.Random(7)
    rows = []
    for i in range(60):
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randrange(3, 40)))
        ring = [[128 + math.cos(t) * r, 35 + math.sin(t) * r] for t, r in ((t, rng.uniform(0.3, 1)) for t in turns)]
        hole = [[128 + x / 8, 35 + y / 8] for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]
        around = max(b - a for a, b in zip([*turns, turns[0] + 2 * math.pi], [*turns[1:], turns[0] + 2 * math.pi, 99], strict=True) if b < 90) < 2.5
        rows.append((i, [[*ring, ring[0]], hole] if around and all(math.dist(p, (128, 35)) > 0.29 for p in ring) and len(turns) > 20 else [[*ring, ring[0]]]))
    flat = [[128.0, 35.0], [129.0, 35.0], [128.5, 35.0], [128.0, 35.0]]
    table = spark.createDataFrame([*rows, (90, [flat]), (91, [[[0.0, 0.0], [0.0, 1.0], [1.0, 1.0], [1.0, 0.0], [0.0, 0.0]]])], "id int, rings array<array<array<double>>>")
    got = {r.id: r for r in table.select("id", "rings", interior_point(F.col("rings")).alias("p"), polygon_area_km2(F.col("rings")).alias("km2")).withColumn("inside", in_polygon(F.col("p.lng"), F.col("p.lat"), F.col("rings"))).collect()}
    assert all(got[i].inside for i, _ in rows) and sum(len(r) > 1 for _, r in rows) > 5
    assert got[90].p is None and (got[91].p.lng, got[91].p.lat) == (0.5, 0.5) and got[91].km2 == pytest.approx(12363.7, rel=1e-3)
