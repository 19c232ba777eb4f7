import random
from collections import Counter

import numpy as np

from sanmaru.llm import quality as Q
from sanmaru.llm.hashing import mixed
from sanmaru.llm.quality import features, fit, fit_sample, keep_accepted, score_quality

SCHEMA = "doc_id long, text string, score string, predicted int"


def text(rng, good):
    words = ["".join(rng.choice("aeioutnrsl") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(20, 60))]
    if good:
        return " ".join(words) + "."
    kind = rng.randrange(3)
    return " ".join(words).upper() + "!!" if kind == 0 else " ".join(w + "%%%" for w in words) if kind == 1 else " ".join([words[0]] * 40)


def labelled(n, seed=3):
    rng = random.Random(seed)
    return [(i, text(rng, good := rng.random() < 0.7), "clash", 1, int(good)) for i in range(n)]


def test_held_out_accuracy(spark):
    rows = labelled(1200)
    docs = spark.createDataFrame([r[:4] for r in rows], SCHEMA)
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows] + [(5, None)], "doc_id long, quality int")
    model = fit_sample(docs, labels, rows=700)
    got = {r.doc_id: r for r in score_quality(docs, model).collect()}
    out = [(r.predicted, y) for *_, y, r in ((*x, got[x[0]]) for x in rows) if r.held_out]
    assert 150 < len(out) < 350 and sum(p == y for p, y in out) / len(out) > 0.97
    again = fit_sample(docs.repartition(7), labels, rows=700)
    assert abs(again.weight - model.weight).max() < 1e-6


def test_odd_texts(spark):
    model = fit(["good text here", "BAD!! TEXT!!"] * 20, [1, 0] * 20)
    rows = [(1, None, "", 0), (2, "", "", 0), (3, " \n", "", 0), (4, "é", "", 0), (5, "a b " * 100_000, "", 0), (None, "good text", "", 0), (6, "good text here", "", 0), (6, "good text here", "", 0)]
    got = score_quality(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    kept = keep_accepted(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert sorted(map(str, kept)) == sorted(str(r) for r in spark.createDataFrame(rows, SCHEMA).collect() if model.score(r.text) >= 0.3)
    assert score_quality(spark.createDataFrame([], SCHEMA), model).count() == 0


def brute_features(text):
    """Word, pair and character-run rows by plain loops over characters."""
    m32, m64, out = (1 << 32) - 1, (1 << 64) - 1, []
    for n in (3, 4, 5):
        for i in range(len(text) - n + 1):
            run = ord(text[i]) + 1
            for c in text[i + 1 : i + n]:
                run = (run * 0x01000193 + ord(c)) & m32
            out.append((((run * 0x9E3779B1) + (n << 20)) & m32) >> (32 - Q.TABLE_BITS))
    mix = lambda x: int(mixed(np.array([x & m64], np.uint64))[0])
    words = [mix(sum((ord(c) + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, c in enumerate(w))) for w in text.replace("\n", " ").split(" ") if w]
    out += [w >> (64 - Q.TABLE_BITS) for w in words]
    return out + [mix(b - a) >> (64 - Q.TABLE_BITS) for a, b in zip(words, words[1:])]


def test_features_against_brute_force(monkeypatch):
    rng = random.Random(1)
    for chunk in (1 << 16, 40, 7):
        monkeypatch.setattr(Q, "CHUNK", chunk)
        for _ in range(30):
            text = "".join(rng.choice("ab é한\n!") for _ in range(rng.randrange(120)))
            if chunk < 60 and max(map(len, text.replace("\n", " ").split(" "))) >= chunk:
                continue  # words longer than a part count as several
            got = Counter(np.concatenate([*features(text), np.zeros(0, np.int64)]).tolist())
            assert got == Counter(brute_features(text))


def test_step_follows_the_gradient():
    rng = np.random.default_rng(2)
    table, layer, bias = rng.normal(size=(6, Q.DIM)), rng.normal(size=(2, Q.DIM)), rng.normal(size=2)
    rows, shares, label = np.array([0, 2, 5]), np.array([0.5, 0.25, 0.25]), 1

    def loss(t, w, b):
        z = w @ (shares @ t[rows]) + b
        return float(np.log(np.exp(z).sum()) - z[label])

    after = [table.copy(), layer.copy(), bias.copy()]
    Q.step(*after, rows, shares, label, 1e-3)
    for k, scale in ((0, 3**0.5), (1, 1.0), (2, 0.1)):
        before = [table, layer, bias]
        for at in np.ndindex(before[k].shape):
            moved = [x.copy() for x in before]
            moved[k][at] += 1e-5
            slope = (loss(*moved) - loss(*before)) / 1e-5
            assert abs(before[k][at] - after[k][at] - 1e-3 * scale * slope) < 1e-6


def test_odd_labels(spark):
    assert fit(["a", None, "b"], [2, 2, -1]).score("x") == 0.5
    docs = spark.createDataFrame([(i, f"text {i}", "", 0) for i in range(40)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 3) for i in range(40)], "doc_id long, quality int")
    assert 0 < fit_sample(docs, labels).score("text") < 1


def test_nothing_to_learn(spark):
    docs, labels = spark.createDataFrame([(1, "x", "", 0)], SCHEMA), spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in score_quality(docs, fit_sample(docs, labels)).collect()] == [0.5]
