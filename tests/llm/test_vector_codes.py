import hashlib
import math
import random

import numpy as np
import pytest

from sanmaru.llm.vector_codes import CellFile, _smallest_ids, code_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, code string, part int"


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def nearest(part, book):
    return min((sum((a - b) ** 2 for a, b in zip(part, c, strict=True)), e) for e, c in enumerate(book))


def brute(rows):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label, *_ in rows if fine(v)]
    width = max(1, -(-max((len(x) for _, x, _ in kept), default=0) // 16))
    kept = [(i, x + [0] * (16 * width - len(x)), label) for i, x, label in kept]
    parts = lambda x: [x[p * width : (p + 1) * width] for p in range(16)]
    firsts = {}
    for i, x, _ in sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]) if r[0] is not None else (True, 0, [])):
        if i is not None:
            firsts.setdefault(i, x)
    seeds = [firsts[i] for i in sorted(firsts)[:64]] or [[0] * 16 * width]
    books = [[parts(x)[p] for x in seeds] for p in range(16)]
    for _ in range(2):
        for p in range(16):
            got = {}
            for _, x, _ in kept:
                got.setdefault(nearest(parts(x)[p], books[p])[1], []).append(parts(x)[p])
            books[p] = [[sum(c) // len(got[e]) for c in zip(*got[e], strict=True)] if e in got else b for e, b in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    coded = []
    for i, x, label in kept:
        found = [nearest(y, books[p]) for p, y in enumerate(parts(x))]
        coded.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    total = {}
    for _, _, error, label in coded:
        total[label] = total.get(label, 0) + error
    return sorted([(i, code, error, total[label], digest) for i, code, error, label in coded], key=str)


def run(spark, rows):
    got = code_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


def row(rng, i, dim, label=None):
    return (i, [rng.choice([-0.5, -0.1, 0.004, 0.3, 1.25]) for _ in range(dim)], label, "clash", 1)


def test_odd_rows_ties_and_repeats(spark):
    rng = random.Random(1)
    rows = [row(rng, 3 * i - 20, 32, i % 4 or None) for i in range(150)]
    rows += rows[:5] + [(7, [0.5] * 32, None, "c", 1), (None, [0.25] * 32, 3, "c", 1), (-900, None, 1, "c", 1), (-901, [1.0, None], 1, "c", 1)]
    rows += [(-902, [float("nan")] * 32, 1, "c", 1), (-903, [float("inf")] * 32, 1, "c", 1), (-904, [], 1, "c", 1), (400, [0.5] * 7, 9, "c", 1), (401, [-0.5] * 35, 9, "c", 1)]
    assert run(spark, rows) == brute(rows)


def test_smallest_distinct_identifiers(spark):
    ids = [5] * 200 + [7] * 90 + list(range(-30, 60, 2)) + [None] * 3
    table = spark.createDataFrame([(i,) for i in ids], "vec_id long").repartition(4)
    want = sorted({i for i in ids if i is not None})
    assert _smallest_ids(table) == want[:64] and _smallest_ids(table, 20) == want[:20] and _smallest_ids(table.limit(0)) == []


def test_few_rows(spark):
    assert run(spark, []) == []
    for rows in ([(4, [0.1] * 16, None, "c", 1)], [(None, [0.1] * 16, None, "c", 1), (None, [], 2, "c", 1)]):
        assert run(spark, rows) == brute(rows)
    with pytest.raises(ValueError):
        run(spark, [(0, [1e30], 1, "c", 1)])


def test_cells_bound_distances_and_screen_entries():
    rng = np.random.default_rng(3)
    for width, size in ((4, 64), (1, 64), (16, 64), (4, 1)):
        entries = rng.integers(-40, 40, (size, width)) if width > 1 else rng.integers(-3, 3, (size, width))
        parts = np.concatenate([rng.integers(-45, 45, (300, width)), entries])
        distance = ((parts[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        cells = CellFile(entries)
        row, entry = cells.candidates(parts)
        kept = np.zeros(distance.shape, bool)
        kept[row, entry] = True
        assert kept[distance == distance.min(axis=1, keepdims=True)].all()  # no nearest entry is screened out
        number, least = cells.nearest(parts)
        assert (number == distance.argmin(axis=1)).all() and (least == distance.min(axis=1)).all()
        assert size == 1 or width != 4 or len(row) < 0.5 * distance.size  # exact distances for less than half of them
