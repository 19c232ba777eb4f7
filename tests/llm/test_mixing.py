import random
import re
from collections import Counter, defaultdict

from hypothesis import given
from hypothesis import strategies as st

from sanmaru.llm.mixing import mix_documents, mix_draws, split_quotas, write_mix

SCHEMA = "doc_id long, text string, source string, size string, target int"


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_targets_and_words(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 7, 300])) if i % 11 else None, rng.choice(["a", "b", "hot", "hot", "hot", "", None, "é"]), "clash", 3) for i in range(400)]
    rows += [(500, "one two\tthree  four", "a", "x", 1), (500, "one two\tthree  four", "a", "x", 1), (None, "x y", "b", "x", 1), (501, "w " * 20_000, "long", "x", 1), (502, "", "empty", "x", 1)]
    sizes, total = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows], defaultdict(int)
    for r, n in zip(rows, sizes, strict=True):
        total[r[2]] += n
    want = brute_targets(total)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mix_documents(docs).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], n) for r, n in zip(rows, sizes, strict=True))
    source = {(r[0], n): r[2] for r, n in zip(rows, sizes, strict=True)}
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id, r.size]
        assert r.source_size == total[s] and abs(r.target - want[s]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in total:
        assert abs(taken[s] - want[s]) <= 0.5
    again = mix_documents(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_shards_are_disjoint_and_whole(spark):
    docs = spark.createDataFrame([(i, "w " * 500, f"s{i % 3}", "", 0) for i in range(300)], SCHEMA)
    draws = mix_draws(docs, shards=4).collect()
    shards = defaultdict(int)
    for r in draws:
        assert (r.shard is None) == (r.words == 0)
        shards[r.shard] += r.words
    whole = [v for k, v in shards.items() if k is not None]
    assert len(whole) == 4 and max(whole) < 1.2 * min(whole)


def test_repeats_spread_over_shards(spark):
    docs = spark.createDataFrame([(i, "w " * 400, "once" if i % 2 else "twice", "", 0) for i in range(1200)], SCHEMA)
    draws = mix_draws(docs, weights=(1, 3), shards=4).filter("words > 0 and source = 'twice'").collect()
    assert {r["pass"] for r in draws} == {0, 1}
    for shard in range(4):
        own = [r["pass"] for r in draws if r.shard == shard]
        assert len(own) > 100 and 0.25 < sum(own) / len(own) < 0.75


@given(st.lists(st.integers(0, 500), min_size=1, max_size=6), st.integers(1, 9))
def test_tree_gives_exact_quotas(quota, shards):
    parts = split_quotas(quota, shards, 7)
    assert len(parts) == shards and [sum(p[i] for p in parts) for i in range(len(quota))] == quota
    assert min(min(p) for p in parts) >= 0
    assert max(map(sum, parts)) - min(map(sum, parts)) <= shards.bit_length() + 1


def test_tree_draws_as_a_hypergeometric_distribution_at_any_size():
    """Mean and variance of what goes left, for few and for very many blocks."""
    for scale in (1, 10_000):
        quota = [30 * scale, 10 * scale, 60 * scale]
        drawn = [split_quotas(quota, 2, seed)[0] for seed in range(600)]
        n, rest = 50 * scale, sum(quota)
        for i, q in enumerate(quota):
            mean = sum(d[i] for d in drawn) / len(drawn)
            spread = sum((d[i] - mean) ** 2 for d in drawn) / len(drawn)
            want = n * (q / rest) * (1 - q / rest) * (rest - n) / (rest - 1)
            assert abs(mean - n * q / rest) < 5 * (want / len(drawn)) ** 0.5 and 0.75 * want < spread < 1.3 * want


def test_written_mix_is_shuffled_by_shard(spark, tmp_path):
    docs = spark.createDataFrame([(i, "w " * 50, f"s{i % 3}", "", 0) for i in range(400)], SCHEMA)
    draws = mix_draws(docs, shards=3)
    write_mix(draws, str(tmp_path / "mix"))
    got = spark.read.parquet(str(tmp_path / "mix")).collect()
    assert sorted((r.doc_id, r["pass"], r.words, r.shard) for r in got) == sorted((r.doc_id, r["pass"], r.words, r.shard) for r in draws.filter("words > 0").collect())
    for shard in range(3):
        keys = [r.order_key for r in spark.read.parquet(str(tmp_path / "mix" / f"shard={shard}")).collect()]
        assert keys == sorted(keys) and len(keys) > 100


def test_empty_table(spark):
    assert mix_documents(spark.createDataFrame([], SCHEMA)).count() == 0
