"""The whole pipeline on a small corpus, stage by stage against brute force."""

import random
import shutil
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

import corpus_pipeline as P
from sanmaru.llm.quality import fit_sample
from test_jaccard_join import brute as near_copies
from test_mixing import brute_targets


def corpus():
    rng = random.Random(5)
    word = lambda: rng.choice("bcdfglmnst") + rng.choice("aeiou") + rng.choice("lmnrst") + rng.choice(["", "a", "en"])
    rows, quality = [], {}
    for i in range(260):
        kind = rng.random()
        base = [word() for _ in range(rng.randrange(30, 120))]
        text = " ".join(base).upper() + "!!" if kind < 0.2 else " ".join(base)
        rows.append((i, text, "en", rng.choice(["hot", "hot", "b", "c"]), len(text)))
        quality[i] = int(kind >= 0.2)
        if kind > 0.8:  # an exact and a near copy
            rows.append((1000 + i, text, "en", "b", len(text)))
            quality[1000 + i] = 1
            rows.append((2000 + i, text + " end", "en", "c", len(text) + 4))
            quality[2000 + i] = 1
    rows += [(5000, None, "en", None, None), (5001, "", "en", "b", 0)]
    return rows, quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, quality = corpus()
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in quality.items()], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = [docs]
    for _, stage in P.STAGES[:-1]:
        steps.append(stage(spark, steps[-1], folder).cache())
        assert steps[-1].columns == docs.columns
    rows = [[tuple(r) for r in s.collect()] for s in steps]
    model = fit_sample(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert {r[0] for r in rows[1]} == {r[0] for r in rows[0] if model.score(r[1]) >= 0.3}
    quality = corpus()[1]
    assert all(quality.get(r[0], 1) for r in rows[1]) and sum(quality.values()) == sum(r[0] in quality for r in rows[1])
    last = {r[1] or "": r[0] for r in sorted(rows[1], key=lambda r: r[0])}
    assert sorted(r[0] for r in rows[2]) == sorted(last.values())
    assert sorted(r[0] for r in rows[3]) == sorted(i for i, _, c in near_copies([r[:2] for r in rows[2]]) if i == c)
    sizes, taken, text = defaultdict(int), defaultdict(int), {r[0]: r for r in rows[3]}
    for r in rows[3]:
        sizes[r[3]] += len((r[1] or "").split())
    for r in rows[4]:
        taken[r[3]] += len(r[1].split())
        assert (text[r[0]][1].split())[: len(r[1].split())] == r[1].split() and r[4] == len(r[1])
    assert all(abs(taken[s] - t) <= 0.5 for s, t in brute_targets(sizes).items())
    packed = P.STAGES[-1][1](spark, steps[-1], folder).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(r[0] for r in rows[4])


def test_run_gives_the_packing(spark, folder):
    out = P.run(spark, folder)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 100


def test_stage_list():
    assert [n for n, _ in P.STAGES] == ["quality", "exact_dedup", "jaccard_join", "mixing", "packing"] and P.ORACLE_SQL is None


def test_rows_with_repeated_shared_and_null_identifiers(spark, folder):
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice("bcdfglmnst") + rng.choice("aeiou") + rng.choice("lmnrst") + rng.choice(["a", "en", "o"]) for _ in range(60))
    a, b, c, d, e, f, g = (text() for _ in range(7))
    junk = b.upper() + "!!"
    rows = [(9001, a), (9001, a), (9001, b), (None, c), (None, c), (None, d), (9002, e), (9003, e + " end"), (9003, f), (9004, g), (9001, junk), (None, junk)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, "en", "odd", len(t)) for i, t in rows]
    docs = spark.read.parquet(f"{folder}/documents.parquet").union(spark.createDataFrame(rows, schema))
    odd = lambda df: Counter((r.doc_id, r.text) for r in df.filter("source = 'odd'").collect())
    clean = P.quality_filter(spark, docs, folder)
    assert odd(clean) == Counter((r[0], r[1]) for r in rows if r[1] != junk)
    once = P.drop_exact_copies(spark, clean, folder)
    assert odd(once) == Counter([(9001, a), (9001, b), (None, c), (None, d), (9002, e), (9003, e + " end"), (9003, f), (9004, g)])
    apart = [(9001, a), (9001, b), (None, c), (None, d), (9002, e), (9003, f), (9004, g)]
    assert odd(P.drop_near_copies(spark, once, folder)) == Counter(apart)
    assert odd(P.drop_near_copies(spark, clean, folder)) == Counter(apart)
    plain = spark.createDataFrame([(i, t, "en", "odd", 0) for i, t in apart + [(9001, a), (9001, a)]], schema)
    mixed = P.mix_by_source(spark, plain, folder).collect()
    size = Counter()
    for r in mixed:
        size[r.doc_id, r.text] += 1
    assert sum(len(r.text.split()) for r in mixed) == 9 * 60 * 3 // 2
    assert all(size[k] >= 1 for k in apart) and size[9001, a] in range(3, 7) and size[None, c] <= 2


def test_empty_tables_and_clashing_columns(spark, folder):
    columns = "text string, doc_id long, row_key_ string, draw_ int, score double, source string, words long, node long, group string, first_ int"
    rows = [(" ".join(f"w{i} is {k}" for k in range(20)), i, "x", 1, 0.5, "s", 7, 3, "g", 0) for i in range(12)]
    for given in ([], rows + rows[:2]):
        docs = spark.createDataFrame(given, columns)
        for name, stage in P.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == [c.split()[0] for c in columns.split(", ")]
            assert not given or name == "mixing" or {r.row_key_ for r in docs.collect()} == {"x"}
        assert (P.STAGES[-1][1](spark, docs, folder).count() > 0) == bool(given)


def test_numbers_of_texts_are_told_apart_by_digest(spark):
    texts = spark.createDataFrame([(i, f"text {i % 30}", f"{i % 30:064d}") for i in range(90)], "doc_id long, text string, sha string")
    rows = P._numbered(texts, width=3).collect()  # 30 digests on 8 first numbers
    assert len(rows) == 90 and len({(r.sha, r.node) for r in rows}) == len({r.node for r in rows}) == 30


def test_columns_of_maps_and_arrays_pass(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "a", 1, {"k": "v"}, [1, 2]), (1, text, "a", 1, {"k": "v"}, [1, 2]), (2, text + " x", "b", 2, {}, None), (3, "other words entirely here", "a", 3, None, [])] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, more map<string, string>, tags array<int>")
    for name, stage in P.STAGES[1:4]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns, name
        kept = got.collect()
        assert {r.doc_id for r in kept} <= {1, 2, 3} and 3 in {r.doc_id for r in kept}
        if name != "mixing":
            assert len(kept) == len({r.doc_id for r in kept})
            assert all(r.more == {1: {"k": "v"}, 2: {}, 3: None}[r.doc_id] for r in kept)


def test_workers_keep_nothing_of_the_packing(spark, folder, tmp_path, monkeypatch):
    own = str(tmp_path / "tokenizer.json")
    shutil.copy(P.tokenizer_path(), own)
    monkeypatch.setattr(P, "tokenizer_path", lambda: own)
    assert P.pack(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).count()

    def held(batches):
        import sys

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"held": [own in vars(sys.modules.get("sanmaru_worker_words", sys))]})

    assert not spark.range(0, 64, 1, 64).mapInArrow(held, "held boolean").filter("held").count()
