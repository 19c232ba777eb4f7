import hashlib
import math
import random

import numpy as np
import pytest

from sanmaru.llm.centroids import cluster_vectors, nearest, screened, segment_norms

SCHEMA = "vec_id long, embedding array<float>, cluster string, x int, norms double"


def brute(rows):
    kept = [(i, [math.floor(64 * float(np.float32(c))) for c in v]) for i, v, *_ in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:16]
    centroids = [list(x) for _, x in seeds]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(3):
        own = {}
        for _, x in kept:
            own.setdefault(near(x)[1], []).append(x)
        centroids = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else c for k, c in enumerate(centroids)]
    placed = [(i, *near(x)) for i, x in kept]
    inertia = {}
    for _, d, k in placed:
        inertia[k] = inertia.get(k, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, k, d, inertia[k], sum(inertia.values()), digest[k]) for i, d, k in placed], key=str)


def run(spark, rows):
    got = cluster_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


def test_odd_rows_ties_and_repeats(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, -0.1, 0.004, 0.3, 1.25]) for _ in range(64)], "clash", 1, 1.0) for i in range(160)]
    rows += rows[:4] + [(500 + i, [0.125] * 64, "c", 1, 1.0) for i in range(60)] + [(3, [0.5] * 64, "c", 1, 1.0), (None, [0.25] * 64, "c", 1, 1.0)]
    rows += [(900, None, "c", 1, 1.0), (901, [1.0] * 63 + [None], "c", 1, 1.0), (902, [float("nan")] * 64, "c", 1, 1.0), (903, [float("-inf")] * 64, "c", 1, 1.0)]
    rows += [(904, [], "c", 1, 1.0), (905, [0.5] * 63, "c", 1, 1.0), (906, [0.5] * 65, "c", 1, 1.0)]
    assert run(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert run(spark, []) == []
    for rows in ([(4, [0.1] * 64, "c", 1, 1.0)], [(None, [0.1] * 64, "c", 1, 1.0), (None, [0.2] * 64, "c", 1, 1.0)]):
        assert run(spark, rows) == brute(rows)
    with pytest.raises(ValueError):
        run(spark, [(0, [1e30] * 64, "c", 1, 1.0)])


def test_norms_bound_distances_and_screen_centroids():
    rng = np.random.default_rng(1)
    for spread in (3, 60, 2**20):
        centroids = rng.integers(-spread, spread, (16, 64)) * rng.integers(1, 5, (16, 8)).repeat(8, axis=1)
        x = np.concatenate([centroids[rng.integers(0, 16, 500)] + rng.integers(-2, 3, (500, 64)), centroids])
        norms = segment_norms(x)
        distance = ((x[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
        assert (screened(norms, centroids) <= distance).all()
        cluster, least, exact = nearest(x, norms, centroids)
        assert (cluster == distance.argmin(axis=1)).all() and (least == distance.min(axis=1)).all()
        assert exact < 0.7 * distance.size
