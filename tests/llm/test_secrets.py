import math
import random
import re
from collections import Counter

from sanmaru.llm.secrets import FEATURES, KEY, candidates, dictionary, fit_forest, labelled_findings, scan_secrets, with_features

SCHEMA = "doc_id long, text string, candidate string, score int"


def docs(n, seed=1):
    rng, rows, planted = random.Random(seed), [], {}
    word = lambda: rng.choice(["the", "house", "river", "going", "tree", "blue", "some"])
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    for i in range(n):
        words, kind = [word() for _ in range(20)], i % 6
        if kind == 0:
            words.insert(5, "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)))
        elif kind == 1:
            words.insert(5, "password=" + hexes(18))
        elif kind == 2:
            words[5:5] = ["token", "=", f'"{hexes(40)}"']
        elif kind == 3:
            words.insert(5, f"{word()}.{i}@mail{i % 9}.example.com")
        elif kind == 4:
            words.insert(5, str(rng.randrange(10**15, 10**16)))
        planted[i] = kind
        rows.append((i, " ".join(words), "clash", 0))
    return rows, planted


def test_finds_planted_secrets_only(spark):
    rows, planted = docs(600)
    got = scan_secrets(spark.createDataFrame(rows, SCHEMA)).collect()
    found = {r.doc_id: r.secret for r in got}
    assert len(found) == len(got)
    for i, kind in planted.items():
        assert found.get(i) == {0: True, 1: True, 2: True, 3: False, 4: False}.get(kind), (i, rows[i])


def test_sql_scores_like_the_trees(spark):
    rng = random.Random(4)
    rows = [[rng.choice([0.0, 0.5, 1.0, rng.random()]) for _ in FEATURES] for _ in range(200)]
    labels = [int(r[0] + r[3] > 1) for r in rows]
    forest = fit_forest(rows, labels, trees=5)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id int, " + ", ".join(f"{f} double" for f in FEATURES))
    got = {r.id: [r[f"t{k}"] for k in range(5)] for r in df.selectExpr("id", *[f"{t.sql()} AS t{k}" for k, t in enumerate(forest)]).collect()}
    assert all(abs(got[i][k] - t.score(r)) < 1e-5 for i, r in enumerate(rows) for k, t in enumerate(forest))
    assert sum((sum(t.score(r) for t in forest) / 5 >= 0.5) == y for r, y in zip(rows, labels, strict=True)) > 185


def test_odd_rows(spark):
    rows = [(1, None, "", 0), (2, "", "", 0), (3, "x" * 200_000 + " key4key4key4key4", "", 0), (None, "password=1234567890abcdef", "", 0), (4, "a1b2c3d4e5f6g7h8", "", 0), (4, "a1b2c3d4e5f6g7h8", "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert candidates(df).count() == 4 and scan_secrets(df).count() == 4
    assert scan_secrets(spark.createDataFrame([], SCHEMA)).count() == 0
    known = spark.createDataFrame([("", "a1b2c3d4e5f6g7h8", 1), ("", "key4key4key4key4", 0)], "before string, candidate string, label int")
    assert scan_secrets(df, known).count() == 4


def test_assigned_words_of_any_look_are_candidates(spark):
    planted = ["password=correcthorsebatterystaple", "api_key=abcdefghijklmnopqrstuvwxyz", "pwd=P@ssw0rd!2024#", "password: hunter2", "secret = x", "Token =abc", '{"passwd":"pw"}']
    plain = ["the river: blue", "ratio=3", "password", "a key", "token: ", "P@ssw0rd!2024#"]
    df = spark.createDataFrame([(i, f"some house {t}", "", 0) for i, t in enumerate(planted + plain)], SCHEMA)
    assert {r.doc_id: r.candidate for r in candidates(df).collect()} == {i: t.split()[-1] for i, t in enumerate(planted)}
    more = spark.createDataFrame([(1000 + i, f"some house {t}", "", 0) for i, t in enumerate(planted)], SCHEMA)
    got = {r.doc_id - 1000: r for r in scan_secrets(spark.createDataFrame(docs(300)[0], SCHEMA).union(more)).collect() if r.doc_id >= 1000}
    assert set(got) == set(range(len(planted))) and got[0].secret and got[1].secret and got[3].secret
    assert {r.doc_id: r.after for r in candidates(spark.createDataFrame([(1, "token: abc one two three", "", 0)], SCHEMA)).collect()} == {1: "one two"}


def test_words_after_a_cue_are_candidates_whatever_they_look_like(spark):
    planted = {"the pass phrase is Tr0ub4dor&3 now": "Tr0ub4dor&3", "use my key Zx9-Qw7_Lk3 here": "Zx9-Qw7_Lk3", "login with correcthorsestaples today": "correcthorsestaples", '(the "Secret") hunter2!': "hunter2!", "PIN 4711": "4711"}
    df = spark.createDataFrame([(i, f"some house {t}", "", 0) for i, t in enumerate(planted)], SCHEMA)
    got = {}
    for r in candidates(df).collect():
        got.setdefault(r.doc_id, set()).add(r.candidate)
    assert all(v in got[i] for i, v in enumerate(planted.values())) and all(len(v) <= 2 for v in got.values())
    plain = spark.createDataFrame([(1, "keys and tokens of secrets", "", 0), (2, "a key", "", 0), (3, "a token - ...", "", 0)], SCHEMA)
    assert candidates(plain).count() == 0


def near_findings(n, seed):
    """Secrets and plain words after cues without a sign: no rule of ``labelled_findings`` knows the secrets."""
    rng, out = random.Random(seed), []
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4)))
    chars = lambda k, of: "".join(rng.choice(of) for _ in range(k))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    for i in range(n):
        secret = rng.random() < 0.5
        value = chars(rng.randrange(8, 12), low + up + dig + "&-_!") if secret else rng.choice([word(), word().title(), word() + ","])
        cue = rng.choice(["my key", "pass phrase", "the password", "a secret"])
        out.append((i, " ".join([*(word() for _ in range(6)), cue, value, *(word() for _ in range(6))]), "", 0, value, int(secret)))
    return out


def test_held_out_on_findings_that_no_rule_labels(spark):
    rows = near_findings(1200, 3)
    found = candidates(spark.createDataFrame([r[:4] for r in rows], SCHEMA)).cache()
    value = {r[0]: (r[4], r[5]) for r in rows}
    assert not {r.candidate for r in labelled_findings(found).filter("label = 1").collect()}
    known = [(r.candidate, r.before, r.after, int(r.candidate == value[r.doc_id][0] and value[r.doc_id][1])) for r in found.collect() if r.doc_id < 600]
    table = spark.createDataFrame(known, "candidate string, before string, after string, label int")
    got = scan_secrets(spark.createDataFrame([r[:4] for r in rows[600:]], SCHEMA), table).collect()
    hit = [r.candidate == value[r.doc_id][0] and value[r.doc_id][1] for r in got if r.secret]
    secrets = sum(r[5] for r in rows[600:])
    assert sum(hit) / secrets > 0.9 and sum(hit) / len(hit) > 0.9
    one = spark.createDataFrame([k for k in known if not k[3]], table.schema)  # findings of one label: nothing is a secret
    assert not any(r.secret for r in scan_secrets(spark.createDataFrame([r[:4] for r in rows[600:640]], SCHEMA), one).collect())


SYLLABLES = "ba co du fe gi la mo nu pe ri sa to vu we".split()


def findings(n, seed):
    """Texts with one finding each and whether it is a secret; no single feature tells them apart."""
    rng, out = random.Random(seed), []
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(2, 4)))
    chars = lambda k, of: "".join(rng.choice(of) for _ in range(k))
    low, up, dig, hexes = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    for i in range(n):
        kind = rng.randrange(8)
        find = [
            lambda: "password=" + chars(16, low + up + dig), lambda: "token: " + chars(32, hexes), lambda: chars(40, low + up + dig + "/+"), lambda: "secret = " + chars(14, low + dig + "!#@"),
            lambda: "/" + "/".join(word() for _ in range(4)) + str(rng.randrange(100)) + ".html", lambda: "commit " + chars(12, hexes) + "-build",
            lambda: "".join(w.title() for w in (word(), word(), word())) + str(rng.randrange(10)), lambda: "password: " + word(),
        ][kind]()
        out.append((i, " ".join([*(word() for _ in range(9)), find, *(word() for _ in range(9))]), "", 0, int(kind < 4)))
    return out


def test_held_out_precision_and_recall(spark):
    """Learned from one half of findings with known truth, measured on the other."""
    rows = findings(1600, 5)
    train, test = rows[:800], rows[800:]
    truth = {r[0]: r[4] for r in rows}
    listed = candidates(spark.createDataFrame([r[:4] for r in train], SCHEMA))
    known = spark.createDataFrame([(r.candidate, r.before, r.after, truth[r.doc_id]) for r in listed.collect()], "candidate string, before string, after string, label int")
    got = scan_secrets(spark.createDataFrame([r[:4] for r in test], SCHEMA), known).collect()
    hit = {r.doc_id for r in got if r.secret}
    secrets = {r[0] for r in test if r[4]}
    assert len(hit & secrets) / len(secrets) > 0.93 and len(hit & secrets) / len(hit) > 0.93
    assert len({r.score for r in got}) > 30


def test_features_against_brute_force(spark):
    rows = findings(120, 9)
    docs = spark.createDataFrame([r[:4] for r in rows], SCHEMA)
    words = dictionary(docs)
    known, pairs = {r.w for r in words.collect()}, Counter()
    for r in words.collect():
        pairs.update({r.w[i : i + 2]: 0 for i in range(len(r.w) - 1)})
        for i in range(len(r.w) - 1):
            pairs[r.w[i : i + 2]] += r.n
    most = max(pairs.values())
    for r in with_features(candidates(docs).select(*KEY).distinct(), words).collect():
        core = re.sub(r"^[A-Za-z_-]+[=:]+", "", r.candidate)
        core = re.sub("^[\"'(\\[<]+|[\"')\\]>.,;:!?]+$", "", core)
        size = max(1, len(core))
        runs = re.findall("[a-z]{2,}", core.lower())
        assert abs(r.covered - sum(len(w) for w in set(runs) if w in known) / size) < 1e-9
        near = re.findall("[a-z]{2,}", (r.before + " " + r.after).lower())
        assert abs(r.near_known - sum(w in known for w in near) / max(1, len(near))) < 1e-9
        both = [core[i : i + 2].lower() for i in range(len(core) - 1) if re.fullmatch("[a-z]{2}", core[i : i + 2].lower())]
        assert abs(r.letters - sum(math.log1p(pairs[b]) / math.log1p(most) for b in both) / max(1, len(both))) < 1e-9
        kinds = "".join("l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "o" for c in core)
        for a in "ludo":
            for b in "ludo":
                assert abs(r[a + b] - sum(kinds[i : i + 2] == a + b for i in range(len(kinds) - 1)) / max(1, len(kinds) - 1)) < 1e-9
        assert r.length == len(core) and r.slashes == core.count("/") and abs(r.digits - sum(c.isdigit() for c in core) / size) < 1e-9
