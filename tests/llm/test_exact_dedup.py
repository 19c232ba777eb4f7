import hashlib
from collections import defaultdict

from sanmaru.llm.exact_dedup import DigestIndex, Run, exact_dedup, may_hold

SCHEMA = "doc_id long, text string, digest string, keep_id int"


def brute(rows, keep):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = keep(known) if known else None
        stays = False
        for i in ids:
            mine = i == best and not stays
            stays |= mine
            out.append((i, best, len(ids), mine, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rows = [(i, f"text {i % 7}" if i % 3 else ("x" * 50_000 if i % 2 else None), "clash", 1) for i in range(60)] + [(5, "text 5", "c", 2), (5, "text 5", "c", 2), (None, "alone", "c", 3), (None, "text 1", "c", 3), (99, "", "c", 3), (100, "Text 1", "c", 3), (101, "text 1 ", "c", 3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for keep, f in (("max", max), ("min", min)):
        got = exact_dedup(docs, keep=keep).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, f)


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_index_against_brute_force(spark):
    """Memtables one after the other, over two compactions: hits and entries after each are those of a dictionary."""
    index, seen = DigestIndex(spark, keep="min", fanout=2), defaultdict(list)
    for ids in ((5, 6, 16), (3, 9, 12), (1,), (20, 21, 4, 4)):
        rows = [(i, bytearray([i % 11])) for i in ids]
        hits = {bytes(r.digest) for r in index.add(spark.createDataFrame(rows, "id long, digest binary")).collect()}
        for i, d in rows:
            seen[bytes(d)].append(i)
        assert hits == {bytes(d) for _, d in rows if len(seen[bytes(d)]) > 1}
        assert {bytes(r.digest): (r.keep_id, r.n) for r in index.entries().collect()} == {d: (min(v), len(v)) for d, v in seen.items()}
    assert [len(level) for level in index.levels] == [0, 0, 1]


def test_filter_passes_all_that_a_run_holds_and_little_else(spark):
    digests = spark.range(40_000).selectExpr("id", "unhex(sha2(cast(id as string), 256)) as digest")
    held, other = digests.filter("id < 20000").select("digest"), digests.filter("id >= 20000").select("digest")
    run = Run(held)
    assert may_hold(held, run).count() == 20_000
    assert may_hold(other, run).count() < 1000
