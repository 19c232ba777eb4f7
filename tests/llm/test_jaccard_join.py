import random
import re

import numpy as np
import pytest

from sanmaru.llm import jaccard_join
from sanmaru.llm.jaccard_join import jaccard_components, shingle_set

SCHEMA = "doc_id long, text string, id string, n int, keys string"


def brute_sets(texts):
    out = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(rows):
    ids, sets = [r[0] for r in rows], brute_sets([r[1] for r in rows])
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(ids[i]), find(ids[j])
                root[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i)) for i, s in zip(ids, sets, strict=True))


def corpus(seed, families=6, size=30):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("aeiou") + str(rng.randrange(300))
    passage = [word() for _ in range(60)]
    texts = [None, "", " \t\n ", "one", "One", "one two", "one two three four", "ÀB c d e f", "àB c d e f", "x\x1cy z a b c", "w " * 30_000]
    for _ in range(families):
        base = [word() for _ in range(rng.choice([6, 40, 120, 400]))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 25])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy + (passage if rng.random() < 0.3 else [])))
    texts += [" ".join(passage + [word() for _ in range(rng.randrange(0, 80))]) for _ in range(40)]
    rng.shuffle(texts)
    return [(i * 3, t, "clash", 1, "c") for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "region", "block", "pivots", "levels"), [(1, 64, 256, 32, 5), (2, 6, 8, 5, 3), (3, 4, 5, 2, 2)])
def test_matches_brute_force(spark, monkeypatch, seed, region, block, pivots, levels):
    """Small limits send the same documents through stars, levels of cells and block pairs."""
    for name, value in (("REGION", region), ("BLOCK", block), ("PIVOTS", pivots), ("LEVELS", levels), ("SALT_ROWS", 10), ("CHUNK", 500)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = corpus(seed)
    got = sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()))
    assert got == brute(rows)


def test_levels_lose_no_link(spark, monkeypatch):
    """One large group, documents at all distances from each other: what the levels connect is what all pairs connect."""
    for name, value in (("BLOCK", 6), ("PIVOTS", 3), ("LEVELS", 4), ("SALT_ROWS", 16)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(11)
    base, sets = list(range(60)), []
    for i in range(260):
        keep = rng.sample(base, rng.randrange(34, 60)) if i % 3 else rng.sample(range(100 + i % 7 * 40, 140 + i % 7 * 40), 36)
        sets.append(sorted(keep))
    rows = [(7 + i % 2, i, s) for i, s in enumerate(sets)]
    got = jaccard_join._large_groups(spark.createDataFrame(rows, "label long, id long, keys array<long>")).collect()
    def roots(pairs):
        root = list(range(len(sets)))
        for a, b in pairs:
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
        out = []
        for i in range(len(sets)):
            while root[i] != i:
                i = root[i]
            out.append(i)
        return out

    linked = lambda a, b: 5 * len(set(sets[a]) & set(sets[b])) >= 4 * len(set(sets[a]) | set(sets[b]))
    assert all(linked(r.a, r.b) for r in got)
    assert roots((r.a, r.b) for r in got) == roots((a, b) for a in range(260) for b in range(a % 2, a, 2) if linked(a, b))


def components_of(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


@pytest.mark.parametrize(("leaf", "pivots", "levels"), [(3, 32, 5), (3, 4, 5), (2, 1, 3), (2, 6, 1)])
def test_pivots_connect_what_all_pairs_connect(monkeypatch, leaf, pivots, levels):
    for name, value in (("LEAF", leaf), ("PIVOTS", pivots), ("LEVELS", levels)):
        monkeypatch.setattr(jaccard_join, name, value)
    for seed in range(12):
        rng = random.Random(seed)
        sets = []
        for family in range(rng.randrange(1, 6)):
            base = list(range(family * 1000, family * 1000 + rng.choice([5, 40, 60])))
            for _ in range(rng.randrange(1, 40)):
                lost = rng.sample(base, rng.randrange(0, len(base) // 3 + 1))
                sets.append(sorted(set(base) - set(lost) | {rng.randrange(9000, 9030) for _ in range(rng.randrange(0, 8))}))
        sets = [np.array(s or [1], np.int64) for s in sets]
        near = lambda a, b: 5 * len(set(a) & set(b)) >= 4 * len(set(a) | set(b))
        links, regions = jaccard_join.metric_links(sets)
        assert all(near(sets[a].tolist(), sets[b].tolist()) for a, b in links)
        lists = [s.tolist() for s in sets]
        assert components_of(len(sets), links) == components_of(len(sets), [(a, b) for a in range(len(sets)) for b in range(a) if near(lists[a], lists[b])])
        assert regions > 0 or len(sets) <= leaf


def test_groups_of_the_given_table_are_split_by_pivots(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").selectExpr("doc_id AS id", "text")
    groups = {}
    for r in jaccard_join.candidate_groups(docs)[4].collect():
        groups.setdefault(r.label, []).append(np.array(r["keys"], np.int64))
    split = [jaccard_join.metric_links(sets)[1] for sets in groups.values()]
    large = sum(len(sets) > jaccard_join.LEAF for sets in groups.values())
    assert large > 20 and sum(n > 0 for n in split) == large and sum(split) > large


def test_hashed_sets_have_the_right_sizes():
    texts = [r[1] for r in corpus(9)]
    hashed, exact = [set(shingle_set(t).tolist()) for t in texts], brute_sets(texts)
    assert [len(s) for s in hashed] == [len(s) for s in exact]
    assert all(len(hashed[i] & hashed[j]) == len(exact[i] & exact[j]) for i in range(60) for j in range(60))


def test_repeated_rows_null_identifiers_and_empty_table(spark):
    text = " ".join(map(str, range(40)))
    rows = [(4, text, "", 0, ""), (4, text, "", 0, ""), (2, text + " x", "", 0, ""), (None, text, "", 0, ""), (9, None, "", 0, "")]
    got = sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(4, 36, 2), (4, 36, 2), (2, 37, 2), (None, 36, None), (9, 0, 9)], key=str)
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    # one text of identifier 4 is a copy of 1's, the other is near to 0's; identifier 6 is a copy of two
    other, third = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, text, "", 0, ""), (4, text, "", 0, ""), (4, other, "", 0, ""), (0, other + " y", "", 0, ""), (5, third, "", 0, ""), (6, third, "", 0, ""), (6, text, "", 0, ""), (8, third + " z", "", 0, "")]
    got = jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and {r.component_id for r in got} == {0}
