import math
import random

import pytest
from pyspark.sql import functions as F

from sanmaru.functions import text as X
from sanmaru.operators import retrieval as R


def test_tokens_hash_and_grams(spark):
    row = spark.createDataFrame([("The Béta-ray, beta a béta 42!",)], "t string").select(X.tokens(F.col("t")).alias("t"), X.fnv1a(F.lit("hello")).alias("h"), X.grams(F.lit("abcd"), 3).alias("g"), X.grams(F.lit("a"), 3).alias("n")).first()
    assert row.t == ["béta", "ray", "beta", "42"] and row.h == 0x4F9F2CAB and row.g == ["abc", "bcd"] and row.n == []


def test_lexical_scores(spark):
    chunks = spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma"), (3, "delta")], "id long, text string")
    asked = spark.createDataFrame([(9, "beta alpha none")], "id long, text string")
    got = {r.id: r.score for r in R.lexical_scores(asked, chunks).collect()}
    part = lambda df: math.log(1 + 3 / (1 + df)) * 2.4 / (1 + 1.4 * (0.25 + 0.75 * 2 / 80))
    assert set(got) == {1, 2} and abs(got[1] - part(1) - part(2)) < 1e-9 and abs(got[2] - part(2)) < 1e-9
    assert [r.id for r in R.best(R.lexical_scores(asked, chunks), 1).collect()] == [1]


def test_cosine_of_zeros(spark):
    row = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>").select(X.cosine(F.col("a"), F.col("b")).alias("z"), X.cosine(F.col("a"), F.col("a")).alias("o")).first()
    assert row.z == 0.0 and row.o == 1.0


def test_vector_scores_in_blocks_of_queries(spark, monkeypatch):
    from sanmaru.operators import retrieval as R

    v = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "id long, vector array<double>")
    whole = sorted(map(tuple, R.vector_scores(v.filter("id < 25"), v).collect()))
    monkeypatch.setattr(R, "MAX_QUERIES", 4)
    assert sorted(map(tuple, R.vector_scores(v.filter("id < 25"), v).collect())) == whole and len(whole) == 25 * 60


def test_hangul_tokens_jamo_and_vectors(spark):
    row = spark.createDataFrame([("인구수 the 값",)], "t string").select(X.tokens(F.col("t")).alias("t"), X.jamo(F.lit("값a가")).alias("j"), X.jamo_distance(F.lit("인구"), F.lit("인고")).alias("d"), X.hash_embed(X.tokens(F.lit("hello"))).alias("v"), X.hash_embed(X.tokens(F.lit(""))).alias("z")).first()
    assert row.t == ["인구수", "인구", "구수"] and row.d == 1
    import unicodedata

    assert row.j == unicodedata.normalize("NFD", "값a가")
    assert abs(sum(v * v for v in row.v) - 1) < 1e-9 and sorted({abs(v) for v in row.v if v})[-1] > 0.8 and set(row.z) == {0.0} and len(row.z) == 64


def corpus(n=1500):
    rng = random.Random(8)
    word = lambda: f"w{int(400 * rng.random() ** 4)}"  # noqa: E731  few words are in nearly all texts
    texts = [(i, " ".join(word() for _ in range(rng.choice([5, 30, 80, 400])))) for i in range(n)]
    texts += [(n + i, texts[i][1]) for i in range(40)] + [(n + 50, ""), (n + 51, None)]  # ties
    asked = [(1, "w0 w1 w2 w300 w350"), (2, "w0 w1"), (3, texts[7][1]), (4, "none of these"), (5, None), (6, "w399 w0")]
    return texts, asked


@pytest.mark.parametrize(("k", "least"), [(4, 0.08), (1, 0.0), (5, 3.0)])
def test_pruned_search_finds_the_best_of_all_scores(spark, k, least):
    texts, asked = corpus()
    chunks = spark.createDataFrame(texts, "id long, text string").repartition(3)
    queries = spark.createDataFrame(asked, "id long, text string")
    scores = [(r.query_id, math.floor(r.score * 1e6 + 0.5) / 1e6, r.id) for r in R.lexical_scores(queries, chunks).collect()]
    want = []
    for q in {s[0] for s in scores}:
        own = sorted((-s, i) for p, s, i in scores if p == q and s > least)[:k]
        want += [(q, i, -s, n + 1) for n, (s, i) in enumerate(own)]
    got = [(r.query_id, r.id, r.score, r.rank) for r in R.top_lexical(queries, chunks, k, least).collect()]
    assert sorted(got) == sorted(want) and (least or len(got) == 4 * k)


def test_pruned_search_scores_few_postings(spark):
    texts, asked = corpus()
    chunks, queries = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(asked, "id long, text string")
    rows, terms = R.postings(queries, chunks)
    every = rows.join(terms, "token").count()
    steps = R.pruned_scores(queries, chunks, 2)
    assert steps.first.count() + steps.essential.count() < 0.6 * every
    assert steps.candidates.count() < 0.2 * R.lexical_scores(queries, chunks).count()


def test_vectors_in_blocks_and_salts(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3) - 1]) for i in range(60)] + [(99, [0.0, 0.0, 0.0])], "id long, vector array<double>")
    whole = {(r.query_id, r.id): r.score for r in R.vector_scores(v, v).collect()}
    monkeypatch.setattr(R, "MAX_QUERIES", 7)
    monkeypatch.setattr(R, "SALT_VECTORS", 20)
    rows = R.vector_scores(v, v).collect()
    assert len(rows) == len(whole) == 61 * 61 and all(abs(whole[r.query_id, r.id] - r.score) < 1e-12 for r in rows)
    assert whole[99, 99] == 0 and abs(whole[1, 1] - 1) < 1e-12
    own = v.withColumn("kind", F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(1))  # one kind has most rows
    for most in (7, 1000):
        monkeypatch.setattr(R, "MAX_QUERIES", most)
        rows = R.vector_scores(own, own, within="kind").collect()
        assert {(r.query_id, r.id) for r in rows} == {(a, b) for a, b in whole if (a if a % 10 == 0 else 1) == (b if b % 10 == 0 else 1)} and len(rows) == 55 * 55 + 6


@pytest.mark.parametrize("most", [3, 1000])
def test_vector_scores_are_sums_in_order_and_odd_vectors_score_null(spark, monkeypatch, most):
    """Scores equal the plain sums bit for bit, in blocks of any size; nulls and unlike lengths have no score."""
    monkeypatch.setattr(R, "MAX_QUERIES", most)
    monkeypatch.setattr(R, "SALT_VECTORS", most + 4)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(40)]
    odd = [(100, None), (101, [1.0, None]), (102, [1.0, 2.0]), (103, [0.0] * 16), (104, [float("nan")] * 16), (105, [])]
    table = spark.createDataFrame(rows + odd, "id long, vector array<double>")
    whole = dict(rows + odd)

    def plain(a, b):
        s = 0.0
        for x, y in zip(a, b):
            s += x * y
        return s

    for unit_length in (True, False):
        got = R.vector_scores(table, table, unit_length).collect()
        assert len(got) == len(whole) ** 2
        for r in got:
            a, b = whole[r.query_id], whole[r.id]
            if a is None or b is None or None in a + b or len(a) != len(b):
                assert r.score is None
                continue
            norm = math.sqrt(plain(a, a)) * math.sqrt(plain(b, b))
            want = plain(a, b) if not unit_length else 0.0 if norm == 0 else plain(a, b) / norm
            assert r.score == want or (math.isnan(want) and math.isnan(r.score))


def test_hybrid_joins_only_queries_of_both_sides(spark, monkeypatch):
    """Queries that one side asks alone keep their pairs and aren't joined; the scores are those of a full join."""
    chunks = spark.createDataFrame([(i, f"word{i % 3} alpha word{i % 5}") for i in range(30)], "id long, text string")
    asked = spark.createDataFrame([(0, "alpha"), (2, "word1 word2"), (4, "none")], "id long, text string")
    v = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(20, 50)] + [(0, [1.0, 0.0, 0.0]), (2, None)], "id long, vector array<double>")
    mine = v.filter("id in (0, 2, 25, 40)")
    want = sorted(map(tuple, R.hybrid(R.lexical_scores(asked, chunks), R.vector_scores(mine, v)).collect()))
    got = R.hybrid_scores(asked, chunks, mine, v)
    assert sorted(map(tuple, got.collect())) == want and {0, 2, 25, 40} == {w[0] for w in want}
    assert len([w for w in want if w[0] == 25]) == 32
