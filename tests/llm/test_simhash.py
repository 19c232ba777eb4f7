import random
import re

import numpy as np
import pytest
import xxhash

from sanmaru.llm import simhash
from sanmaru.llm.simhash import Forest, band_keys, fingerprint, fingerprint_links, simhash_components

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, fp string, component_id int"


def brute_print(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    nodes = [(i, p) for i, p in prints if i is not None]
    root = {i: i for i, _ in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, p) in enumerate(nodes):
        for j, q in nodes[:n]:
            if (p ^ q).bit_count() <= 4 and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return sorted(((i, f"{p:016x}", None if i is None else find(i)) for i, p in prints), key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeäöß") for _ in range(rng.randrange(2, 7)))
    rows, base = [], [word() for _ in range(400)]
    for i in range(90):
        words = list(base) if i % 3 else [word() for _ in range(rng.randrange(1, 60))]
        for _ in range(rng.randrange(0, 4) if i % 3 else 0):
            words[rng.randrange(len(words))] = word()
        rows.append((i, rng.choice([" ", "\n", "\t\x0b "]).join(words).title() if i % 5 else " ".join(words)))
    rows += [(200, None), (201, ""), (202, " \n "), (203, "one"), (204, "ONE"), (205, "a b c"), (206, "a  b C"), (207, "a b c d"), (None, "a b c"), (None, None), (203, "one"), (10, "other text of a shared identifier"), (208, "x" * 50_000 + " y z w v"), (5, None)]
    return rows


def test_fingerprints(monkeypatch):
    texts = [None, "", " \r\n", "a", "a b", "A b c d", "É b c d e f g", "w " * 9000, *(t for _, t in corpus()[:20])]
    for chunk in (7, 1 << 20):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        assert [fingerprint(t) % (1 << 64) for t in texts] == [brute_print(t) for t in texts]


@pytest.mark.parametrize("shard", [4096, 8])
def test_components_against_all_pairs(spark, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    rows = corpus()
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    got = simhash_components(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert simhash_components(spark.createDataFrame([], SCHEMA)).collect() == []


def near(rng, center, n, most):
    out = {center}
    while len(out) < n:
        x = rng.choice(sorted(out)) if rng.random() < 0.5 else center
        for _ in range(rng.randrange(1, most)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return out


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def groups(prints):
    """Components by comparing all pairs."""
    x = np.array(prints, np.int64)
    linked = np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= 4
    label = np.arange(len(x))
    while True:
        least = np.where(linked, label[None, :], len(x)).min(axis=1)
        if (least == label).all():
            return label
        label = least


def mixed_prints(n=600):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(n)}
    for _ in range(12):
        prints |= near(rng, rng.getrandbits(64), 40, 9)
    prints |= near(rng, rng.getrandbits(64), 300, 4)
    return sorted(map(signed, prints))


def test_trees_follow_only_edges_within_the_radius(monkeypatch):
    monkeypatch.setattr(simhash, "ASKING", 64)
    prints = np.array(mixed_prints(), np.int64)
    shard = np.arange(len(prints)) % 3
    forest = Forest(shard, prints)
    inside = [np.flatnonzero(shard == s) for s in range(3)]
    for node, parent in enumerate(forest.parent):  # children are keyed by their distance to the parent, and are in its tree
        if parent >= 0:
            assert forest.edge[node] == (int(forest.fp[node] ^ forest.fp[parent]) % (1 << 64)).bit_count()
            assert shard[forest.node[node]] == shard[forest.node[parent]]
    found = {(int(q), int(i)) for qs, items in forest.hits(prints, forest.root) for q, i in zip(qs, items, strict=True)}
    wanted = {(int(a), int(b)) for rows in inside for a in rows for b in rows if (int(prints[a] ^ prints[b]) % (1 << 64)).bit_count() <= 4}
    assert found == wanted
    forest.join()
    for rows in inside:
        own = groups(prints[rows])
        assert (rows[own] == forest.label[rows]).all()


@pytest.mark.parametrize(("shard", "more", "sent"), [(4096, None, 64 << 20), (16, None, 64 << 20), (16, None, 0), (4096, 100, 64 << 20)])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, shard, more, sent):
    """Small shards, shards split into broadcast trees, trees joined by a shuffle, and two bands for a shard."""
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "broadcast_bytes", lambda df, *c: None if not sent else F.broadcast(df))
    if more:
        monkeypatch.setattr(simhash, "MORE_BANDS", (more,))
    prints = mixed_prints(200)
    rng = random.Random(9)
    hot = rng.getrandbits(64)
    prints = sorted({*prints, *(signed(hot ^ (rng.getrandbits(20) << 40)) for _ in range(150))})  # one value in three bands
    table = spark.createDataFrame(list(zip(prints, range(len(prints)), strict=True)), "fp long, rep long").repartition(3).cache()
    links = fingerprint_links(table).collect()
    label = simhash._joined(len(prints), np.array([r.a for r in links]), np.array([r.b for r in links]))
    assert (label == groups(prints)).all()
    assert all((a.a != a.b) for a in links) and len(links) < 16 * len(prints)


def test_linked_prints_share_a_shard(spark):
    rng = random.Random(4)
    for at_once in (1, 2, 3):
        rows = []
        for _ in range(40):
            x = y = rng.getrandbits(64)
            for b in rng.sample(range(64), 4):
                y ^= 1 << b
            rows.append((signed(x), signed(y)))
        pairs = spark.createDataFrame(rows, "x long, y long")
        assert pairs.filter(F.arrays_overlap(band_keys(F.col("x"), at_once), band_keys(F.col("y"), at_once))).count() == 40
