"""Regions by quadtree cover against a plain test of every point with every polygon."""

import math
import random

import pytest

from sanmaru.operators import cover as C

POINTS, REGIONS = "id long, lat double, lng double", "code string, ordinal int, polygons array<array<array<array<double>>>>"


def on_segment(x, y, a, b):
    box = min(a[0], b[0]) <= x <= max(a[0], b[0]) and min(a[1], b[1]) <= y <= max(a[1], b[1])
    return box and (b[0] - a[0]) * (y - a[1]) == (b[1] - a[1]) * (x - a[0])


def where(x, y, ring):
    """1 inside, 0 on the ring, -1 outside."""
    edges = list(zip(ring, ring[1:], strict=False))
    if any(on_segment(x, y, a, b) for a, b in edges):
        return 0
    odd = sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in edges) % 2
    return 1 if odd else -1


def inside(x, y, polygons):
    return any(where(x, y, p[0]) >= 0 and not any(where(x, y, h) > 0 for h in p[1:]) for p in polygons)


def star(rng, cx, cy, radius, n):
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    ring = [[cx + math.cos(t) * r, cy + math.sin(t) * r] for t, r in ((t, radius * rng.uniform(0.4, 1)) for t in turns)]
    return [*ring, ring[0]]


def box(a, b, c, d):
    return [[a, b], [c, b], [c, d], [a, d], [a, b]]


def regions():
    rng = random.Random(11)
    good = [
        ("fine", 3, [[star(rng, 127.9, 34.9, 0.6, 400), box(127.85, 34.87, 127.95, 34.93)]]),
        ("two", 1, [[star(rng, 128.6, 35.2, 0.3, 60)], [box(129.0, 35.0, 129.5, 35.5), box(129.125, 35.125, 129.25, 35.25)]]),
        ("wide", 7, [[box(127.0, 34.0, 130.0, 36.0)]]),
        ("south", 2, [[box(-3.0, -2.0, -1.5, -0.25)]]),
        ("crosses", 0, [[[[128.0, 35.5], [128.5, 35.875], [128.5, 35.5], [128.0, 35.875], [128.0, 35.5]]]]),
    ]
    bad = [
        ("open", -1, [[box(127.0, 34.0, 130.0, 36.0)[:4]]]), ("short", -2, [[[[1.0, 1.0], [2.0, 2.0], [1.0, 1.0]]]]), ("none", -3, None), ("empty", -4, []),
        ("no rings", -5, [[]]), ("null ring", -6, [[None]]), ("null place", -7, [[[[127.0, 34.0], None, [130.0, 36.0], [127.0, 34.0]]]]),
        ("not a number", -8, [[[[127.0, 34.0], [float("nan"), 34.0], [130.0, 36.0], [127.0, 34.0]]]]), ("flat", -9, [[[[127.0], [128.0], [129.0], [127.0]]]]),
    ]
    return good, bad


def places():
    rng = random.Random(5)
    good, _ = regions()
    spots = [(rng.uniform(126.8, 130.1), rng.uniform(33.9, 36.1)) for _ in range(500)]
    spots += [(rng.uniform(-3.2, -1.3), rng.uniform(-2.2, 0.0)) for _ in range(60)]
    spots += [tuple(p) for _, _, polygons in good for p in polygons[0][0][:12]]  # corners
    spots += [(129.0, 35.25), (129.125, 35.2), (129.2, 35.125), (129.2, 35.2), (128.25, 35.5), (128.5, 35.6), (127.5, 34.0), (130.0, 35.0), (130.0, 36.0), (128.25, 35.6875)]  # edges
    rows = [(i, y, x) for i, (x, y) in enumerate(spots)]
    return [*rows, (9001, None, 128.0), (9002, 35.0, None), (9003, float("nan"), 128.0), (9004, 35.0, float("inf"))]


@pytest.mark.parametrize("cells", [{}, {"most": 3, "coarse": 1, "fine": 7}])
def test_every_point_and_region(spark, cells):
    good, bad = regions()
    table = spark.createDataFrame(good + bad, REGIONS)
    rows = places()
    spots = spark.createDataFrame(rows, POINTS).repartition(3)
    fine = lambda v: v is not None and math.isfinite(v)
    want = {(i, code) for i, y, x in rows for code, _, polygons in good if fine(x) and fine(y) and inside(x, y, polygons)}
    got = [(r.id, r.code) for r in C.regions_of(spots, table, **cells).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    order = {code: n for code, n, _ in good}
    first = {r.id: r.region_code for r in C.assign_regions(spots, table, **cells).collect()}
    assert first == {i: min((c for j, c in want if j == i), key=order.get, default=None) for i, _, _ in rows}


def test_cells_split_where_shapes_are_fine_and_only_borders_are_tested(spark):
    good, _ = regions()
    edges = C.edge_rows(spark.createDataFrame(good, REGIONS)).cache()
    cells = C.cover(edges, most=8).collect()
    level = lambda code: {r.level for r in cells if r.code == code}
    assert level("wide") == {2} and max(level("fine")) > 4  # a rectangle of four edges is never split
    shape = {code: polygons for code, _, polygons in good}
    for r in cells:
        size = 2.0**-r.level
        corners = [((r.ix + i) * size, (r.iy + j) * size) for i in (0.01, 0.5, 0.99) for j in (0.01, 0.5, 0.99)]
        assert not r.inner or all(inside(x, y, shape[r.code]) for x, y in corners)
    nested = [(r.code, r.level, r.ix, r.iy) for r in cells]
    assert len(nested) == len(set(nested))
    have = set(nested)
    assert not any((c, n - k, x >> k, y >> k) in have for c, n, x, y in nested for k in range(1, n - 1))  # a leaf has no leaves above it
    counts = {(r.code, r.ix, r.iy) for r in cells if not r.inner and r.level == 9}
    assert len(counts) < len(cells)


def test_no_regions_no_points(spark):
    good, bad = regions()
    spots = spark.createDataFrame(places()[:3], POINTS)
    assert [r.region_code for r in C.assign_regions(spots, spark.createDataFrame(bad, REGIONS)).collect()] == [None] * 3
    assert C.assign_regions(spots.limit(0), spark.createDataFrame(good[1:3], REGIONS)).collect() == []


def test_rings_stand_for_one_polygon(spark):
    table = spark.createDataFrame([("p", 0, [box(0.0, 0.0, 2.0, 2.0), box(0.5, 0.5, 1.0, 1.0)]), ("q", 1, [box(0.0, 0.0, 4.0, 4.0)])], "code string, ordinal int, rings array<array<array<double>>>")
    spots = spark.createDataFrame([(1, 1.5, 1.5), (2, 0.7, 0.7), (3, 3.0, 3.0), (4, 9.0, 9.0)], POINTS)
    assert {r.id: r.region_code for r in C.assign_regions(spots, table).collect()} == {1: "p", 2: "q", 3: "q", 4: None}
