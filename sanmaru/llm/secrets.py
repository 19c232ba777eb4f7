"""Secret scans with a random forest that removes false positives. DataFrame functions only on the main path.

Candidates are long words that look like keys, all words that a cue assigns and all words right after a cue. The forest reads their length, the
frequencies of transitions between classes of characters and between letters, dictionary coverage, path marks and the
words before and after. It learns from labelled findings, at most ``MAX_FINDINGS``; its trees become one SQL expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sanmaru.llm.common import WORD, broadcast_bytes, cut

#: Characters of a candidate at least that no cue assigns.
LEAST = 12
#: Labelled findings to learn from at most, trees and their depth.
MAX_FINDINGS, TREES, DEPTH, LEAF, SEED = 4000, 15, 8, 3, 3
#: Words of the dictionary, the most frequent ones of the corpus, and their least length.
DICTIONARY, DICTIONARY_LETTERS = 20_000, 2
# Words that name a secret, and prefixes of keys with a public format.
CUES = "password passwd pwd secret token key apikey api_key auth bearer credential credentials access private".split()
KNOWN = r"(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|ghp_[0-9A-Za-z]{36}|xox[abp]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35}|sk_live_[0-9A-Za-z]{16,})"
# Words after which a secret may stand without a sign between, besides the cues.
NEARBY = (*CUES, "passphrase", "phrase", "passcode", "pin", "login", "logins")
NEAR = r"(?i)(?<![\p{L}0-9_])(?:" + "|".join(NEARBY) + r")(?![\p{L}0-9_])"
#: A word, of any length and characters, that follows a cue with = or : or holds one, at the end of a text of up to three words.
ASSIGNS = r"(?i)(?:" + "|".join(CUES) + r")[^\s=:]{0,64}\s*[=:]"
ASSIGNED = ASSIGNS + r"+\s*[^\s=:]\S*$"
KEYLIKE = "[0-9]|[A-Z]{16}|[a-z][A-Z].*[a-z][A-Z]"
#: Classes of characters, and the pairs of neighbours whose frequencies are features.
CLASSES = "ludo"
TRANSITIONS = tuple(a + b for a in CLASSES for b in CLASSES)
FEATURES = (
    "length", "digits", "uppers", "lowers", "others", "hex", "covered", "letters", "near_known", "slashes", "address", "path_near", "cue", "cue_before", "assigned", "quoted", "at_sign", "period",
    *TRANSITIONS,
)
KEY = ["candidate", "before", "after"]


def dictionary(docs: DataFrame, words: int = DICTIONARY) -> DataFrame:
    """``w, n``: the corpus' most frequent words of letters, by number of documents; a report of fixed size."""
    each = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{%d,}" % DICTIONARY_LETTERS), 0))).alias("w"))
    counted = each.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return cut(counted.orderBy(F.desc("n"), "w").limit(words))


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, finding_no, before, candidate, after`` of all words that hold a run of ``LEAST`` key characters and also a
    digit, mixed case or a run of 16 capitals, of all words that follow or hold a cue with = or :, and of the two words
    after a cue that stands alone (marks aside), whatever they look like. ``before`` and ``after`` are up to two words."""
    run = r"[A-Za-z0-9+/_=.\-]{%d,}" % LEAST
    listed = docs.filter(F.col("text").rlike(run) | F.col("text").rlike(ASSIGNS) | F.col("text").rlike(NEAR)).select("doc_id", F.regexp_extract_all("text", F.lit(WORD), 0).alias("words"), F.col("text").rlike(NEAR).alias("cued"))

    def alone(w: Column) -> Column:
        return F.coalesce(F.lower(F.regexp_replace(w, "^[^\\p{L}=:]+|[^\\p{L}=:]+$", "")).isin(*NEARBY), F.lit(False))

    def wanted(w: Column, last: Column, second: Column) -> Column:
        marked = F.exists(F.array(w, F.coalesce(last, F.lit(""))), lambda x: x.contains("=") | x.contains(":"))  # spares most words the next test
        near = F.when(F.col("cued"), (alone(last) | (alone(second) & ~F.coalesce(last, F.lit("")).rlike("[=:]"))) & w.rlike(r"[\p{L}0-9]")).otherwise(False)
        return ((F.length(w) >= LEAST) & w.rlike(KEYLIKE) & w.rlike(run)) | (marked & F.concat_ws(" ", second, last, w).rlike(ASSIGNED)) | near

    def near(i: Column, *steps: int) -> Column:
        return F.concat_ws(" ", *[F.get("words", i + k) for k in steps])

    found = F.filter(
        F.transform("words", lambda w, i: F.when(wanted(w, F.get("words", i - 1), F.get("words", i - 2)), F.struct(near(i, -2, -1).alias("before"), w.alias("candidate"), near(i, 1, 2).alias("after")))),
        lambda s: s.isNotNull(),
    )
    return listed.select("doc_id", F.posexplode(found).alias("finding_no", "f")).select("doc_id", "finding_no", "f.before", "f.candidate", "f.after")


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _looked_up(keys: DataFrame, words: DataFrame) -> DataFrame:
    """``keys`` with what their parts amount to in the dictionary: letters of known words, known neighbours, common pairs of letters.

    All parts of a key, each once with its number, meet the dictionary and its pairs of letters in one join.
    """
    pair = F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring(F.col("w"), i, F.lit(2)))
    pairs = words.select(F.explode(pair).alias("t"), "n").groupBy("t").agg(F.sum("n").alias("n"))
    most = pairs.agg(F.max("n").alias("most"))
    table = words.select(F.lit("w").alias("kind"), F.col("w").alias("t"), F.length("w").cast("double").alias("v"))
    table = table.union(words.select(F.lit("c"), "w", F.lit(1.0))).union(pairs.join(F.broadcast(most)).select(F.lit("b"), "t", F.log1p("n") / F.log1p("most")))  # ``most`` is one row
    lower = F.lower("core")

    def parts(kind: str, items: Column) -> Column:
        return F.transform(items, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("t")))

    run = F.lit(r"\p{L}{%d,}" % DICTIONARY_LETTERS)
    letters = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("core") - 1)), lambda i: F.substring(lower, i, F.lit(2))), lambda t: t.rlike(r"^\p{L}{2}$"))
    neighbours = F.regexp_extract_all(F.lower(F.concat_ws(" ", "before", "after")), run, 0)
    tokens = keys.select(*KEY, F.explode(F.concat(parts("w", F.array_distinct(F.regexp_extract_all(lower, run, 0))), parts("c", neighbours), parts("b", letters))).alias("p"))
    tokens = tokens.groupBy(*KEY, "p").agg(F.count(F.lit(1)).alias("times")).select(*KEY, "p.kind", "p.t", "times")
    found = tokens.join(F.broadcast(table), ["kind", "t"], "left")  # at most DICTIONARY words twice and their pairs of letters
    share = lambda kind: F.coalesce(F.try_divide(F.sum(F.when(F.col("kind") == kind, F.coalesce("v", F.lit(0.0)) * F.col("times"))), F.sum(F.when(F.col("kind") == kind, F.col("times")))), F.lit(0.0))
    sums = found.groupBy(*KEY).agg(F.coalesce(F.sum(F.when(F.col("kind") == "w", F.col("v"))), F.lit(0.0)).alias("known"), share("c").alias("near_known"), share("b").alias("letters"))
    return keys.join(sums, KEY, "left").fillna(0.0, ["known", "near_known", "letters"])


def with_features(keys: DataFrame, words: DataFrame) -> DataFrame:
    """``keys(candidate, before, after)`` with the columns of ``FEATURES``; ``core`` is the candidate without name and quotes."""
    core = F.regexp_replace(F.regexp_replace("candidate", r"^[A-Za-z_-]+[=:]+", ""), "^[\"'(\\[<]+|[\"')\\]>.,;:!?]+$", "")
    keys = _looked_up(keys.withColumn("core", core), words)
    size = F.greatest(F.length("core"), F.lit(1))
    kinds = F.col("core")
    for pattern, kind in ((r"\p{Ll}", "l"), ("[A-Z]", "u"), ("[0-9]", "d"), ("[^lud]", "o")):
        kinds = F.regexp_replace(kinds, pattern, kind)
    cue = "(?i)(?:" + "|".join(CUES) + ")"
    simple = keys.withColumn("kinds", kinds).select(
        "*",
        F.length("core").cast("double").alias("length"),
        (_count(F.col("core"), "[0-9]") / size).alias("digits"),
        (_count(F.col("core"), "[A-Z]") / size).alias("uppers"),
        (_count(F.col("core"), r"\p{Ll}") / size).alias("lowers"),
        (_count(F.col("core"), r"[\p{L}0-9]+") / size).alias("alnum"),
        F.col("core").rlike("^[0-9a-f]+$").cast("double").alias("hex"),
        (F.col("known") / size).alias("covered"),
        _count(F.col("core"), "[/\\\\]").cast("double").alias("slashes"),
        F.col("core").rlike(r"(?i)^(?:https?:|www\.)|\.[a-z]{2,4}$").cast("double").alias("address"),
        F.concat_ws(" ", "before", "after").rlike(r"[/\\]").cast("double").alias("path_near"),
        F.lower("candidate").rlike(cue + "[^=:]*[=:]").cast("double").alias("cue"),
        F.col("before").rlike(cue).cast("double").alias("cue_before"),
        (F.col("candidate").rlike("^[A-Za-z_-]+[=:]") | F.col("before").rlike("[=:]$")).cast("double").alias("assigned"),
        F.col("candidate").rlike("^[\"']|[=:][\"']").cast("double").alias("quoted"),
        F.col("core").contains("@").cast("double").alias("at_sign"),
        _count(F.col("core"), r"\.").cast("double").alias("period"),
    )
    steps = [(F.regexp_count("kinds", F.lit(f"{a}(?={b})")) / F.greatest(F.length("kinds") - 1, F.lit(1))).alias(a + b) for a, b in TRANSITIONS]
    return simple.select("*", (1 - F.col("alnum")).alias("others"), *steps)


@dataclass
class Tree:
    """A split of ``feature`` at ``at`` (left if not above), or a leaf with the share of secrets."""

    share: float
    feature: int = -1
    at: float = 0.0
    left: Tree | None = None
    right: Tree | None = None

    def sql(self) -> str:
        if self.left is None or self.right is None:
            return f"{self.share:.6f}D"
        return f"CASE WHEN {FEATURES[self.feature]} <= {self.at!r}D THEN {self.left.sql()} ELSE {self.right.sql()} END"

    def score(self, x: list[float]) -> float:
        node = self
        while node.left is not None and node.right is not None:
            node = node.left if x[node.feature] <= node.at else node.right
        return node.share


def _grow(rng: np.random.Generator, rows: np.ndarray, labels: np.ndarray, at: np.ndarray, depth: int) -> Tree:
    """Gini splits over a random part of the features."""
    n, ones = len(at), int(labels[at].sum())
    leaf = Tree((ones + 0.5) / (n + 1))
    if depth == 0 or n < 2 * LEAF or ones in (0, n):
        return leaf
    best = (2 * ones * (n - ones) / n - 1e-9, -1, 0.0)
    for f in rng.permutation(rows.shape[1])[: math.isqrt(rows.shape[1]) + 2].tolist():
        order = np.argsort(rows[at, f], kind="stable")
        values, left, k = rows[at, f][order], np.cumsum(labels[at][order])[:-1], np.arange(1, n)
        right = ones - left
        impurity = 2 * left * (k - left) / k + 2 * right * (n - k - right) / (n - k)
        impurity[(values[1:] <= values[:-1]) | (k < LEAF) | (k > n - LEAF)] = np.inf
        j = int(impurity.argmin())
        if impurity[j] < best[0]:
            best = (float(impurity[j]), f, float(values[j] + values[j + 1]) / 2)
    if best[1] < 0:
        return leaf
    low = rows[at, best[1]] <= best[2]
    return Tree(leaf.share, best[1], best[2], _grow(rng, rows, labels, at[low], depth - 1), _grow(rng, rows, labels, at[~low], depth - 1))


def fit_forest(rows: list[list[float]], labels: list[int], trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list[Tree]:
    """Trees on bootstrap samples; one leaf if there is nothing to learn from."""
    rng = np.random.default_rng(seed)
    if not rows:
        return [Tree(0.0)]
    x, y = np.array(rows, np.float64), np.array(labels, np.int64)
    return [_grow(rng, x, y, rng.integers(0, len(y), len(y)), depth) for _ in range(trees)]


def forest_score(forest: list[Tree]) -> Column:
    return F.expr("(" + " + ".join(f"({t.sql()})" for t in forest) + f") / {len(forest)}")


def fit_findings(findings: DataFrame, words: DataFrame) -> list[Tree]:
    """A forest from ``findings(candidate, before, after, label)``: at most half of ``MAX_FINDINGS`` of each label, by a hash."""
    findings = findings if "after" in findings.columns else findings.withColumn("after", F.lit(""))
    shares = cut(findings.filter("label in (0, 1)").groupBy(*KEY).agg(F.max("label").alias("label")))
    order = [F.xxhash64(*KEY), *KEY]
    halves = [shares.filter(F.col("label") == label).orderBy(*order).limit(MAX_FINDINGS // 2) for label in (0, 1)]
    taken = cut(halves[0].unionByName(halves[1]))
    sample = with_features(taken, words).orderBy(*KEY).select(*FEATURES, "label").collect()
    return fit_forest([[float(r[f]) for f in FEATURES] for r in sample], [int(r.label) for r in sample])


def labelled_findings(found: DataFrame) -> DataFrame:
    """Findings that formats and context label for certain: keys of a public format and assigned hexadecimal secrets are 1;
    addresses, numbers and words of letters with a stray digit or none are 0, unless a cue assigns them or they are long and
    stand after one; what is left has no label."""
    core, before = F.col("candidate"), F.col("before")
    named = F.concat_ws(" ", before, core)
    positive = core.rlike(KNOWN) | (named.rlike(r"(?i)(?:" + "|".join(CUES) + r")[\"']?\s*[=:]\s*[\"']?[0-9A-Za-z+/_-]{12,}[\"']?[.,;]?$") & core.rlike("[0-9].*[0-9]"))
    negative = core.rlike("@|://|^www[.]") | core.rlike(r"^[\"'(]?[0-9][0-9.,:+()/-]*[\"').,;]*$") | core.rlike(r"^\p{L}*[0-9]{0,2}\p{L}*[.,;:!?]*$")
    return found.withColumn("label", F.when(positive, 1).when(negative & ~named.rlike(ASSIGNED), 0)).filter("label is not null")


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """One row for each candidate: ``doc_id, finding_no, candidate, score, secret``.

    ``findings(candidate, before, label)``, with ``after`` if there is one, are labelled; by default ``labelled_findings`` of the corpus itself. Null
    and empty texts have no candidates. Candidates are numbered in text order; repeated rows repeat their candidates. An
    empty table gives no rows; other columns are ignored. Texts are read twice, for candidates and for the dictionary;
    features are computed once for all findings that agree in word and neighbours.
    """
    docs = docs.select("doc_id", "text")
    found = cut(candidates(docs))
    words = dictionary(docs)
    forest = fit_findings(findings if findings is not None else labelled_findings(found), words)
    keys = found.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows"))
    scored = cut(with_features(keys, words).select(*KEY, forest_score(forest).alias("score")))
    small = broadcast_bytes(scored, *KEY)
    out = found.join(scored if small is None else small, KEY)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("finding_no").cast("long").alias("finding_no"), "candidate", "score", (F.col("score") >= threshold).alias("secret"))
