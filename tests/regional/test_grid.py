"""Least squares, places of bins and reconciliation against numpy and plain loops."""

import math
import random

import numpy as np
import pytest

from sanmaru.operators import grid as G


def planar(n=300):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        x, y = rng.uniform(1_000_000, 1_170_000), rng.uniform(1_600_000, 1_750_000)
        rows.append((i, x, y, 120 + x * 9e-6 + y * 3e-7 + (x - 1e6) ** 2 * 1e-14, 20 + y * 9e-6 - x * 2e-7 + rng.gauss(0, 1e-5)))
    return rows


COLUMNS = "id long, x double, y double, lon double, lat double"


def test_affine_fit_equals_numpy(spark):
    rows = planar()
    extra = [(900, None, 1.0, 1.0, 1.0), (901, 1.0, float("nan"), 1.0, 1.0), (902, 1.0, 1.0, float("inf"), 1.0)]
    row = G.affine_fit(spark.createDataFrame(rows + extra, COLUMNS)).first()
    m = np.array([[1, (r[1] - 1e6) / 1e5, (r[2] - 1.6e6) / 1e5] for r in rows])
    assert row.n == len(rows)
    for axis, column in (("lon", 3), ("lat", 4)):
        a, b, c = np.linalg.lstsq(m, np.array([r[column] for r in rows]), rcond=None)[0]
        want = (a - b * 10 - c * 16, b / 1e5, c / 1e5)
        assert np.allclose([row[f"{axis}_0"], row[f"{axis}_x"], row[f"{axis}_y"]], want, rtol=1e-7)


def test_more_regressors_and_dependent_ones(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4)) + 5
    y = x @ [1.5, -2.0, 0.25, 3.0] + 7 + rng.normal(size=200) * 0.1
    table = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, d double, t double")
    row = G.least_squares(table, ["a", "b", "c", "d"], ["t"]).first()
    want = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0]
    assert np.allclose([row.t_0, row.t_a, row.t_b, row.t_c, row.t_d], want)
    twice = table.selectExpr("a", "2 * a + 1 AS b", "t")
    assert G.least_squares(twice, ["a", "b"], ["t"]).first().t_b is None
    few = G.least_squares(table.limit(2), ["a", "b"], ["t"]).first()
    assert few.n == 2 and few.t_a is None
    assert G.least_squares(table.limit(0), ["a"], ["t"]).first().n == 0


def test_places_near_anchors_beat_the_fit_of_the_whole(spark):
    rows = planar()
    table = spark.createDataFrame(rows, COLUMNS).repartition(3)
    fit = G.affine_fit(table).first()
    size = 20_000.0
    anchors = {}
    for i, x, y, lon, lat in rows:
        key = (math.floor(x / size), math.floor(y / size))
        far = round((x - (key[0] + 0.5) * size) ** 2 + (y - (key[1] + 0.5) * size) ** 2, 6)
        anchors[key] = min(anchors.get(key, (far, i)), (far, i))
    got = {r.bin: r for r in G.bin_places(table, size).collect()}
    assert {k: r.anchor for k, r in got.items()} == {f"{a}_{b}": i for (a, b), (_, i) in anchors.items()}
    for (a, b), (_, i) in anchors.items():
        _, x, y, lon, lat = rows[i]
        dx, dy = (a + 0.5) * size - x, (b + 0.5) * size - y
        r = got[f"{a}_{b}"]
        assert abs(r.lon - (lon + fit.lon_x * dx + fit.lon_y * dy)) < 1e-9 and abs(r.lat - (lat + fit.lat_x * dx + fit.lat_y * dy)) < 1e-9
    off = G.place_errors(table, size).first()
    whole = max(abs(fit.lon_0 + fit.lon_x * x + fit.lon_y * y - lon) for _, x, y, lon, _ in rows)
    assert off.n == len(rows) and 0 < off.worst_lon < whole


def box(a, b, c, d):
    return [[a, b], [c, b], [c, d], [a, d], [a, b]]


@pytest.fixture
def sides(spark):
    regions = spark.createDataFrame([("a", 0, [[box(0.0, 0.0, 1.0, 1.0)]]), ("b", 1, [[box(0.0, 0.0, 2.0, 1.0)], [box(5.0, 5.0, 6.0, 6.0)]]), ("c", 2, [[box(8.0, 8.0, 9.0, 9.0)]]), ("z", 3, [[box(3.0, 0.0, 4.0, 1.0)]])], "code string, ordinal int, polygons array<array<array<array<double>>>>")
    rows = spark.createDataFrame([("g1", 60.0), ("g1", 45.0), ("g2", 50.0), ("g3", None), ("g3", 30.0), ("g4", 7.0), ("g5", 11.0), ("g5", 1.0), ("g6", 4.0)], "gid string, value double")
    places = spark.createDataFrame([("g1", 0.5, 0.5), ("g2", 0.5, 1.5), ("g3", 5.5, 5.5), ("g4", 7.0, 7.0), ("g6", 0.5, 3.5), ("g9", 0.1, 0.1)], "gid string, lat double, lng double")
    totals = spark.createDataFrame([("a", 100.0), ("b", 200.0), ("c", 50.0), ("z", 0.0)], "code string, total double")
    return G.grid_sums(rows, places), totals, regions


def test_reconciliation_of_two_grains(sides):
    got = {r.code: (r.grid, r.total, None if r.ratio is None else round(r.ratio, 6), r.fits) for r in G.reconcile(*sides).collect()}
    assert got == {"a": (105.0, 100.0, 1.05, True), "b": (80.0, 200.0, 0.4, False), "c": (None, 50.0, None, None), "z": (4.0, 0.0, None, None), None: (7.0, None, None, None)}
    assert [r.code for r in G.worst(G.reconcile(*sides)).collect()] == ["b"]
    row = G.reconciliation(*sides).first().asDict()
    want = {"compared": 2, "fitting": 1, "outside_grids": 1, "outside_value": 7.0, "unplaced_rows": 2, "grid_total": 189.0, "region_total": 350.0, "share": 0.5, "ratio": 189 / 350}
    assert row == pytest.approx(want)
