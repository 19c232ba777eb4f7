from pyspark.sql import functions as F

from sanmaru.functions import codes as K
from sanmaru.functions.text import term_frequency
from sanmaru.operators.retrieval import hash_vectors
from sanmaru.functions.text import hash_embed, tokens
from sanmaru.sources import discovery as V


def put(root, folder, name, text="x"):
    path = root / folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_only_new_folders_are_taken(spark, tmp_path):
    root, manifest = tmp_path / "in", str(tmp_path / "seen")
    put(root, "202401", "grid.txt"), put(root, "202402", "grid.txt/part-0", "ab"), put(root, "202402", "grid.txt/part-1", "c"), put(root, "202402", "grid.txt/_SUCCESS", ""), put(root, "202403", "other.txt"), put(root, "202404", "my-grid.txt.bak")
    found = {r.folder: (r.files, r.bytes) for r in V.month_folders(spark, str(root), "grid.txt").collect()}
    assert found == {"202401": (1, 1), "202402": (2, 3)}
    first = V.new_folders(spark, str(root), "grid.txt", manifest)
    assert {r.folder for r in first.collect()} == {"202401", "202402"}
    assert {r.folder for r in V.new_folders(spark, str(root), "grid.txt", manifest).collect()} == {"202401", "202402"}  # not marked yet
    V.mark_seen(first.filter("folder = '202401'"), manifest)
    put(root, "202405", "grid.txt")
    assert {r.folder for r in V.new_folders(spark, str(root), "grid.txt", manifest).collect()} == {"202402", "202405"}


def test_names_hours_windows_and_counts(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    name = lambda s: one(K.district_name(F.lit(s), "경상남도"))
    assert [name(s) for s in ("경상남도 창원시 의창구 동읍", "경상남도 진주시 천전동", "김해시", "창원시 구산면", "")] == ["창원시 의창구", "진주시", "김해시", "창원시", ""]
    hours = lambda s: one(K.hours_map(F.lit(s)))
    assert hours('{"mon": "09-18", "tue": null, "n": 1, "b": true, "o": {"a": "x"}}') == {"mon": "09-18", "tue": None}
    assert [hours(s) for s in ('{"n": 1}', "{}", "[1]", '"text"', "broken{", None)] == [None] * 6
    windows = lambda m: one(K.month_windows(F.array(*map(F.lit, m)), 4))
    assert windows(list(range(9))) == [[0, 1, 2, 3], [4, 5, 6, 7], [8]] and windows([5]) == [[5]]
    assert one(K.month_run(F.lit(2024 * 12), 3)) == ["2023-11", "2023-12", "2024-01"]
    assert one(term_frequency(F.array(F.lit("a"), F.lit("b"), F.lit("a")), "a")) == 2


def test_hashed_vectors_by_grouping_equal_the_expression(spark):
    chunks = spark.createDataFrame([(1, "alpha beta 인구수 gamma"), (2, ""), (3, None), (4, "alpha")], "id long, text string")
    want = {(r.id, i): v for r in chunks.filter("text is not null").select("id", hash_embed(tokens(F.col("text"))).alias("v")).collect() for i, v in enumerate(r.v) if v}
    got = {(r.id, r.idx): r.value for r in hash_vectors(chunks).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_hash_vectors_add_up_rows_of_one_id(spark):
    """Long, repeated and astral tokens; rows of one id are one vector, and no join of tokens is needed."""
    import math

    from sanmaru.functions.text import hash_embed, tokens

    texts = [(1, "alpha beta " + "x" * 300), (2, None), (3, ""), (4, "값어치 인구수"), (5, "alpha"), (5, "beta gamma alpha"), (6, "beta \U00020000\U00020001")]
    chunks = spark.createDataFrame(texts, "id long, text string")
    got = {}
    rows = hash_vectors(chunks)
    for r in rows.collect():
        got.setdefault(r.id, {})[r.idx] = r.value
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString() and set(got) == {1, 4, 5, 6}
    for r in chunks.filter("id in (1, 4)").select("id", hash_embed(tokens(F.col("text"))).alias("v")).collect():
        assert got[r.id].keys() == {i for i, v in enumerate(r.v) if v} and all(abs(got[r.id][i] - v) < 1e-12 for i, v in enumerate(r.v) if v)

    def spots(words):
        out = {}
        for w in words:
            h = 2166136261
            for c in w:
                h = (h ^ ord(c)) * 16777619 & 4294967295
            g, sign = (h ^ ord("#")) * 16777619 & 4294967295, 1.0 if h % 2 == 0 else -1.0
            for at, v in ((h % 64, sign), (g % 64, sign / 2)):
                out[at] = out.get(at, 0.0) + v
        norm = math.sqrt(sum(v * v for v in out.values()))
        return {k: v / norm for k, v in out.items() if v}

    assert got[5] == spots(["alpha", "beta", "gamma", "alpha"]) and got[6] == spots(["beta", "\U00020000\U00020001"])
