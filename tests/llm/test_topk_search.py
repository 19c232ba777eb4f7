import math
import random

import numpy as np
import pytest

from sanmaru.llm import topk_search
from sanmaru.llm.topk_search import top_k

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def brute(rows, k, every=50):
    fine = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, x in {i: v for i, v in sorted(fine, reverse=True) if i % every == 0}.items():  # the smallest of repeated rows
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in fine if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, k=5):
    return sorted(map(tuple, top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), k).collect()))


def vectors(n, seed=0):
    rng = random.Random(seed)
    return [(i, [rng.choice([-1.0, -0.5, 0.25, 0.3, 1.0]) for _ in range(8)], "clash", 1) for i in range(n)]


def test_ties_and_odd_vectors(spark):
    rows = vectors(400) + [(1000 + i, [1.0] * 8, "c", 1) for i in range(300)] + [(50_000, [1.0, None], "c", 1), (2001, [float("nan")] * 8, "c", 1), (2002, [float("inf")] * 8, "c", 1), (2003, None, "c", 1), (2004, [], "c", 1), (None, [1.0] * 8, "c", 1), (2050, [1.0, 1.0], "c", 1), (7, rows7 := [1.0] * 8, "c", 1), (7, rows7, "c", 1), (4000, [], "c", 1), (4050, [0.5] * 8, "c", 1), (4050, [0.25] * 8, "c", 1)]
    assert run(spark, rows) == brute(rows, 5)


def test_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK_QUERIES", 3)
    rows = vectors(600, 2)
    assert run(spark, rows, 3) == brute(rows, 3)


def test_fewer_candidates_than_k(spark):
    rows = vectors(3)
    assert run(spark, rows) == brute(rows, 5)
    assert run(spark, rows[:1]) == []


def test_empty_table_and_no_queries(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], "c", 1)]) == []


def test_scores_beyond_exact_floats(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(2**20, 2**22)) for _ in range(5)], "c", 1) for i in range(120)]
    got = run(spark, rows, 4)
    assert got == brute(rows, 4) and max(r[3] for r in got) > 2**53
    with pytest.raises(ValueError):
        run(spark, [(0, [1e30], "c", 1)])
