"""Queries of text functions, retrieval and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sanmaru.functions import codes as K
from sanmaru.functions import text as X
from sanmaru.functions.numeric import clamp, half_up, percentage
from sanmaru.operators import retrieval as R
from sanmaru.operators import suggest as G
from sanmaru.plans.cube_queries import r6, sql6
from sanmaru.plans.registry import query
from sanmaru.sources.bindings import _month_no, cells, table, with_ctes

_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_TOK = (
    "list_distinct(flatten(list_transform(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), lambda w: list_concat(CASE WHEN length(w) >= 2 AND w NOT IN (" + _STOP + ") THEN [w] ELSE [] END, "
    "CASE WHEN regexp_matches(w, '[가-힣]{{2}}') THEN list_concat(list_transform(range(1, length(w)), lambda i: substr(w, i, 2)), list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3))) ELSE [] END))))"
)
_DOC = f"d AS (SELECT doc_id AS id, {_TOK.format('text')} AS t FROM documents), r AS (SELECT id, len(t) AS length, unnest(t) AS token FROM d)"
_IDF = "i AS (SELECT token, count(*) AS df, ln(1 + (SELECT count(*) FROM documents) / (1 + count(*))) AS idf FROM r GROUP BY 1)"
_ASK = f"a AS (SELECT item_id AS query_id, unnest({_TOK.format('text')}) AS token FROM benchmark)"
_LEX = f"WITH {_DOC}, {_IDF}, {_ASK}, s AS (SELECT query_id, id, sum(idf * 2.4 / (1 + 1.4 * (0.25 + 0.75 * length / 80.0::DOUBLE))) AS score FROM r JOIN i USING (token) JOIN a USING (token) GROUP BY 1, 2)"


def chunks(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")


@query("fn_tokenize", f"SELECT doc_id AS id, len(t)::INT AS n, array_to_string(list_sort(t), ' ') AS tokens FROM (SELECT doc_id, {_TOK.format('text')} AS t FROM documents)")
def fn_tokenize(spark, d):
    return chunks(spark, d).withColumn("t", X.tokens(F.col("text"))).select("id", F.size("t").alias("n"), F.array_join(F.array_sort("t"), " ").alias("tokens"))


@query("agg_idf", f"WITH {_DOC}, {_IDF} SELECT token, df, {sql6('idf', 'idf')} FROM i")
def agg_idf(spark, d):
    c = chunks(spark, d)
    return R.idf(R.document_tokens(c), c).select("token", "df", r6("idf"))


@query("fn_bm25", f"{_LEX} SELECT query_id, id, {sql6('score', 'score')} FROM s")
def fn_bm25(spark, d):
    return R.lexical_scores(asked(spark, d), chunks(spark, d)).select("query_id", "id", r6("score"))


@query("topk_rag", f"{_LEX}, q AS (SELECT query_id, id, {sql6('score', 'score')} FROM s) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM q WHERE score > 0.08 QUALIFY rank <= 4")
def topk_rag(spark, d):
    return R.top_lexical(asked(spark, d), chunks(spark, d), 4, 0.08).select("query_id", "id", "score", "rank")


@query("fn_score_norm", f"{_LEX}, m AS (SELECT query_id, least(min(score), 0) AS lo, greatest(max(score), 1e-9) AS hi FROM s GROUP BY 1) SELECT query_id, id, {sql6('(score - lo) / (hi - lo)', 'score')} FROM s JOIN m USING (query_id)")
def fn_score_norm(spark, d):
    return R.normal_scores(R.lexical_scores(asked(spark, d), chunks(spark, d))).select("query_id", "id", r6("score"))


_COS = "list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])))"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query("fn_cosine", f"SELECT q.vec_id AS query_id, v.vec_id AS id, {sql6(_COS, 'score')} FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0")
def fn_cosine(spark, d):
    v = _vectors(spark, d)
    return R.vector_scores(v.filter("id % 50 = 0"), v).select("query_id", "id", r6("score"))


@query("fn_dot", f"SELECT q.vec_id AS query_id, v.vec_id AS id, {sql6('list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])', 'score')} FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0")
def fn_dot(spark, d):
    v = _vectors(spark, d)
    return R.vector_scores(v.filter("id % 50 = 0"), v, unit_length=False).select("query_id", "id", r6("score"))


@query("fn_hybrid", f"{_LEX}, m AS (SELECT query_id, least(min(score), 0) AS lo, greatest(max(score), 1e-9) AS hi FROM s GROUP BY 1), l AS (SELECT query_id, id, (score - lo) / (hi - lo) AS l FROM s JOIN m USING (query_id)), v AS (SELECT q.vec_id AS query_id, v.vec_id AS id, {_COS} AS v FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0) SELECT query_id, id, {sql6('0.55 * coalesce(l, 0) + 0.45 * coalesce(v, 0)', 'score')} FROM l FULL JOIN v USING (query_id, id)")
def fn_hybrid(spark, d):
    v = _vectors(spark, d)
    return R.hybrid_scores(asked(spark, d), chunks(spark, d), v.filter("id % 50 = 0"), v).select("query_id", "id", r6("score"))


@query("fn_context", f"{_LEX}, q AS (SELECT query_id, id, {sql6('score', 'score')} FROM s), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM q QUALIFY rank <= 4) SELECT query_id, id, rank, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS used FROM t JOIN documents ON doc_id = id QUALIFY used <= 20000")
def fn_context(spark, d):
    c = chunks(spark, d)
    hits = R.top_lexical(asked(spark, d), c, 4, float("-inf")).join(c, "id")
    return R.context(hits, 20000).select("query_id", "id", "rank", "used")


_WORDS = "w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)"


def part_words(spark, d):
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()


@query("fn_fnv1a", f"WITH {_WORDS} SELECT word, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(word, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS hash FROM w WHERE word <> ''")
def fn_fnv1a(spark, d):
    return part_words(spark, d).filter("word <> ''").select("word", X.fnv1a(F.col("word")).alias("hash"))


#: Letters of part names as syllables, so that names have jamo.
_NAME_LETTERS, _NAME_SYLLABLES = "abcdefghijklmnopqrstuvwxyz", "가나다라마바사아자차카타파하거너더러머버서어저처커터"
_SHAPE = "[" + ", ".join(f"'{w}'" for w in G.SHAPE_WORDS) + "]"
_SUGGEST = f"""
WITH k0 AS (
  SELECT DISTINCT p_name AS metric, split_part(p_name, ' ', 1) AS label, 0 AS ordinal, translate(p_name, '{_NAME_LETTERS}', '{_NAME_SYLLABLES}') AS trigger FROM part
  UNION ALL SELECT DISTINCT p_name, split_part(p_name, ' ', 1), 1, translate(split_part(p_name, ' ', 2), '{_NAME_LETTERS}', '{_NAME_SYLLABLES}') || '율' FROM part),
k1 AS (SELECT *, replace(trigger, ' ', '') AS key FROM k0),
q AS (
  SELECT p_partkey AS id, translate(CASE p_partkey % 5 WHEN 0 THEN split_part(p_name, ' ', 2) WHEN 1 THEN replace(p_name, substr(p_name, 1 + (p_partkey % 4)::INT, 1), 'k') WHEN 2 THEN substr(p_name, 1, length(p_name) - 2) || 'xz'
    WHEN 3 THEN replace(p_name, 'e', 's') ELSE substr(p_name, 3) END, '{_NAME_LETTERS}', '{_NAME_SYLLABLES}') || ' 높은 곳' AS text FROM part),
qc AS (SELECT id, text, replace(text, ' ', '') AS compact FROM q),
k AS (
  SELECT *, array_to_string(list_transform(string_split(key, ''), lambda c: chr(48 + (ascii(c) - 44032) // 588) || chr(67 + (ascii(c) - 44032) % 588 // 28) || CASE WHEN (ascii(c) - 44032) % 28 > 0 THEN chr(87 + (ascii(c) - 44032) % 28) ELSE '' END), '') AS j
  FROM k1 WHERE length(key) >= 3),
w AS (SELECT id, unnest(list_filter(regexp_extract_all(text, '[가-힣]{{2,}}'), lambda x: NOT list_contains({_SHAPE}, x))) AS word FROM q),
c AS (SELECT id, metric, any_value(label) AS label, arg_min(trigger, ordinal) AS trigger, 0 AS distance FROM w JOIN k ON contains(key, word) GROUP BY id, metric),
n AS (SELECT DISTINCT length(key) AS n FROM k),
u0 AS (SELECT DISTINCT id, n, substr(compact, pos, n) AS r FROM (SELECT id, compact, n, unnest(range(1, length(compact) - n + 2)) AS pos FROM qc, n)),
u AS (SELECT id, n, array_to_string(list_transform(string_split(r, ''), lambda c: chr(48 + (ascii(c) - 44032) // 588) || chr(67 + (ascii(c) - 44032) % 588 // 28) || CASE WHEN (ascii(c) - 44032) % 28 > 0 THEN chr(87 + (ascii(c) - 44032) % 28) ELSE '' END), '') AS j FROM u0),
t AS (SELECT id, metric, ordinal, any_value(label) AS label, any_value(trigger) AS trigger, min(levenshtein(u.j, k.j)) AS distance, any_value(greatest(1, floor(length(k.j) * 0.3::DOUBLE + 0.5))) AS most FROM u JOIN k ON length(key) = n GROUP BY id, metric, ordinal),
b AS (SELECT id, metric, arg_min(struct_pack(label, trigger, distance, most), (distance, ordinal)) AS b FROM t WHERE NOT EXISTS (FROM c WHERE c.id = t.id AND c.metric = t.metric) GROUP BY id, metric),
f AS (SELECT id, metric, label, trigger, distance FROM c UNION ALL SELECT id, metric, b.label, b.trigger, b.distance FROM b WHERE b.distance <= b.most),
o AS (SELECT id, label, min(struct_pack(distance, metric, trigger)) AS m FROM f GROUP BY id, label)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY m.distance, label)::INT AS rank, m.metric AS metric, label, m.trigger AS trigger, m.distance::INT AS distance FROM o QUALIFY rank <= 3
"""


@query("nl_suggest", _SUGGEST)
def nl_suggest(spark, d):
    """Names of parts, mistyped in several ways, against the names and their second words."""
    hangul = lambda c: F.translate(c, _NAME_LETTERS, _NAME_SYLLABLES)
    name, k = F.col("p_name"), F.col("p_partkey")
    part = table(spark, d, "part")
    first, second = F.get(F.split(name, " "), F.lit(0)), F.get(F.split(name, " "), F.lit(1))
    triggers = F.array(hangul(name), F.concat(hangul(second), F.lit("율")))
    metrics = part.select("p_name").distinct().select(name.alias("metric"), first.alias("label"), F.posexplode(triggers).alias("ordinal", "trigger"))
    typo = F.when(k % 5 == 0, second).when(k % 5 == 1, F.replace(name, F.substring(name, (k % 4 + 1).cast("int"), F.lit(1)), F.lit("k")))
    typo = typo.when(k % 5 == 2, F.concat(F.substring(name, F.lit(1), F.length(name) - 2), F.lit("xz"))).when(k % 5 == 3, F.replace(name, F.lit("e"), F.lit("s"))).otherwise(F.substring(name, F.lit(3), F.length(name)))
    return G.suggest_metrics(part.select(k.alias("id"), F.concat(hangul(typo), F.lit(" 높은 곳")).alias("text")), metrics)


@query("flt_name_any", with_ctes("cells", "SELECT code, name FROM cells WHERE contains(replace(name, ' ', ''), 'ASIA') OR contains(replace(name, ' ', ''), 'FRICAK')"))
def flt_name_any(spark, d):
    return cells(spark, d).filter(R.any_word(F.col("name"), ["ASIA", "FRICAK"])).select("code", "name")


# Scalar functions over order rows.
_O = "SELECT o_orderkey AS id, {0} FROM orders"


def _orders(spark, d, *cols):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), *cols)


@query("fn_round_half_up", _O.format("floor((o_totalprice - 150000) / 8 + 0.5) AS v"))
def fn_round_half_up(spark, d):
    return _orders(spark, d, half_up((F.col("o_totalprice") - 150000) / 8, 0).alias("v"))


@query("fn_percentage", _O.format("CASE WHEN o_custkey % 5 > 0 THEN " + "floor((o_orderkey % 7) / (o_custkey % 5) * 100 * 1e6 + 0.5) / 1e6 END AS v"))
def fn_percentage(spark, d):
    return _orders(spark, d, r6(percentage(F.col("o_orderkey") % 7, F.col("o_custkey") % 5), "v"))


@query("fn_clamp", _O.format("CASE WHEN o_custkey % 3 > 0 THEN greatest(0, least(100, o_totalprice / 2000)) END AS v"))
def fn_clamp(spark, d):
    return _orders(spark, d, clamp(F.when(F.col("o_custkey") % 3 > 0, F.col("o_totalprice") / 2000), 0.0, 100.0).alias("v"))


@query("fn_month_no", _O.format("(year(o_orderdate) * 12 + month(o_orderdate) - 1)::INT AS v"))
def fn_month_no(spark, d):
    return _orders(spark, d, K.month_no(F.date_format("o_orderdate", "yyyy-MM")).alias("v"))


@query("fn_month_norm", _O.format("CASE WHEN o_orderkey % 4 < 2 THEN strftime(o_orderdate, '%Y-%m') END AS v"))
def fn_month_norm(spark, d):
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.date_format("o_orderdate", "yyyyMM")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM")).when(k == 2, F.lit("2001-13")).otherwise(F.lit("x"))
    return _orders(spark, d, K.normal_month(raw).alias("v"))


@query("fn_prev_month", _O.format("strftime(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH, '%Y-%m') AS v"))
def fn_prev_month(spark, d):
    return _orders(spark, d, K.month_label(K.month_no(F.date_format("o_orderdate", "yyyy-MM")) - 1).alias("v"))


@query("fn_quarter_label", _O.format("year(o_orderdate)::VARCHAR || '-' || lpad((quarter(o_orderdate) * 3)::VARCHAR, 2, '0') AS v"))
def fn_quarter_label(spark, d):
    return _orders(spark, d, K.quarter_label(F.concat(F.year("o_orderdate").cast("string"), F.quarter("o_orderdate").cast("string"))).alias("v"))


@query("fn_hour_norm", "SELECT event_id AS id, lpad(hour(ts)::VARCHAR, 2, '0') AS v FROM events")
def fn_hour_norm(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), K.hour_label(F.concat(F.lit(" "), F.hour("ts").cast("string"))).alias("v"))


@query("fn_hhmm", "SELECT event_id AS id, CASE WHEN hour(ts) < 23 THEN hour(ts) * 60 + minute(ts) END::INT AS v FROM events")
def fn_hhmm(spark, d):
    """24:00 and later are no time of day."""
    h = F.hour("ts")
    clock = F.concat(F.lpad(F.when(h == 23, 24).otherwise(h).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.minute("ts").cast("string"), 2, "0"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), K.minutes(clock).alias("v"))


@query("fn_clean_code", _O.format("lpad(o_orderkey::VARCHAR, 10, '0') AS v"))
def fn_clean_code(spark, d):
    raw = F.concat(F.lit('﻿"'), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.lit('"'))
    return _orders(spark, d, K.clean_code(raw).alias("v"))


@query("fn_alias_first", _O.format("CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_orderstatus END AS v"))
def fn_alias_first(spark, d):
    a = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).when(F.col("o_orderkey") % 3 == 1, F.lit("  "))
    return _orders(spark, d, K.first_known(a, F.col("o_orderstatus")).alias("v"))


@query("fn_num_clean", _O.format("CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey::DOUBLE END AS v"))
def fn_num_clean(spark, d):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.lit("-5")).otherwise(F.format_number("o_orderkey", 0))
    return _orders(spark, d, K.count_number(raw).alias("v"))


@query("fn_sgg_code", with_ctes("cells", "SELECT code, substr(code, 1, 5) AS v FROM cells"))
def fn_sgg_code(spark, d):
    return cells(spark, d).select("code", K.parent_code(F.col("code")).alias("v"))


@query("fn_parent_name", with_ctes("cells", "SELECT code, array_to_string(string_split(name, ' ')[1:2], ' ') AS v FROM cells"))
def fn_parent_name(spark, d):
    return cells(spark, d).select("code", K.parent_name(F.col("name")).alias("v"))


@query("join_code_pad", with_ctes("cells", "SELECT code, substr(code, 3) || '00' AS padded FROM cells"))
def join_code_pad(spark, d):
    return cells(spark, d).select("code", K.pad_code(F.substring("code", 3, 8)).alias("padded"))


@query("fn_base_unit", "SELECT p_partkey AS id, trim(split_part(p_type || ' / ' || p_brand, '/', 1)) AS v FROM part")
def fn_base_unit(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), K.base_unit(F.concat("p_type", F.lit(" / "), "p_brand")).alias("v"))


@query("fn_facility_type", "SELECT p_partkey AS id, CASE WHEN contains(p_type, 'BRASS') THEN 'clinic' WHEN contains(p_type, 'STEEL') THEN 'hospital' WHEN contains(p_type, 'TIN') THEN 'pharmacy' ELSE 'public' END AS v FROM part")
def fn_facility_type(spark, d):
    """Ordered substring rules."""
    t = F.col("p_type")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(t.contains("BRASS"), "clinic").when(t.contains("STEEL"), "hospital").when(t.contains("TIN"), "pharmacy").otherwise("public").alias("v"))


@query("fn_specialties", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 > 0 THEN array_to_string(string_split(p_name, ' '), '|') END AS v FROM part")
def fn_specialties(spark, d):
    raw = F.when(F.col("p_partkey") % 3 > 0, F.regexp_replace("p_name", " ", " ,, ")).otherwise(F.lit(" , "))
    parts = F.filter(F.transform(F.split(raw, ","), lambda s: F.trim(s)), lambda s: s != "")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.size(parts) > 0, F.array_join(parts, "|")).alias("v"))


@query("fn_month_windows", "WITH m AS (SELECT DISTINCT (year(o_orderdate) * 12 + month(o_orderdate) - 1)::INT AS m FROM orders) SELECT ((row_number() OVER (ORDER BY m) - 1) // 4)::INT AS part, m AS month_no FROM m")
def fn_month_windows(spark, d):
    """The months of orders in windows of at most four: each month with the number of its window."""
    months = table(spark, d, "orders").select(_month_no("o_orderdate").alias("month_no")).distinct()
    parts = K.month_windows(F.array_sort(F.collect_list("month_no")), 4)
    return months.agg(parts.alias("w")).select(F.posexplode("w").alias("part", "months")).select("part", F.explode("months").alias("month_no"))  # months of a calendar fit a row


@query("fn_month_gen", "WITH m AS (SELECT o_orderkey AS id, (year(o_orderdate) * 12 + month(o_orderdate) - 1)::INT AS m FROM orders) SELECT id, list_transform(range(m - 12, m + 1), lambda x: lpad((x // 12)::VARCHAR, 4, '0') || '-' || lpad((x % 12 + 1)::VARCHAR, 2, '0')) AS months FROM m")
def fn_month_gen(spark, d):
    """13 months that end with each order's."""
    return _orders(spark, d, K.month_run(_month_no("o_orderdate"), 13).alias("months"))


@query("fn_date_version", _O.format("try_strptime(lpad((o_orderkey % 99999999)::VARCHAR, 8, '0'), '%Y%m%d') IS NOT NULL AND (o_orderkey % 99999999) >= 10101 AS v"))
def fn_date_version(spark, d):
    raw = F.lpad((F.col("o_orderkey") % 99999999).cast("string"), 8, "0")
    return _orders(spark, d, (F.try_to_date(raw, "yyyyMMdd").isNotNull() & (F.col("o_orderkey") % 99999999 >= 10101)).alias("v"))


@query("fn_natural", with_ctes("series", "SELECT code, month, births - deaths AS v FROM series"))
def fn_natural(spark, d):
    from sanmaru.sources.bindings import region_series

    return region_series(spark, d).select("code", "month", (F.col("births") - F.col("deaths")).alias("v"))


@query("fn_ratio_series", with_ctes("series", f"SELECT code, month, {sql6('elderly / nullif(population, 0) * 100', 'v')} FROM series"))
def fn_ratio_series(spark, d):
    from sanmaru.sources.bindings import region_series

    return region_series(spark, d).select("code", "month", r6(F.col("elderly") / F.nullif(F.col("population"), F.lit(0)) * 100, "v"))


# Korean words: letters of part names written as syllables. The SQL writes jamo as single ASCII characters, since DuckDB counts bytes.
_LATIN, _SYLLABLES = "abcdefghijklmnopqrstuvwxyz", "각난닫랄맘밥삿앙잦찿캌탙팦핳까따빠싸짜가나다라마바사"


def _jamo_sql(text: str, first: int, middle: int, last: int) -> str:
    c = "(ord(c) - 44032)"
    return f"array_to_string(list_transform(string_split({text}, ''), lambda c: CASE WHEN {c} BETWEEN 0 AND 11171 THEN chr(({first} + {c} // 588)::INT) || chr(({middle} + {c} % 588 // 28)::INT) || CASE WHEN {c} % 28 > 0 THEN chr(({last} + {c} % 28)::INT) ELSE '' END ELSE c END), '')"


_KO = f"k AS (SELECT p_partkey AS id, translate(split_part(p_name, ' ', 1), '{_LATIN}', '{_SYLLABLES}') AS a, translate(split_part(p_name, ' ', 2), '{_LATIN}', '{_SYLLABLES}') AS b FROM part)"


def korean_pairs(spark, d):
    words = F.split("p_name", " ")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), *[F.translate(F.coalesce(F.get(words, F.lit(i)), F.lit("")), _LATIN, _SYLLABLES).alias(n) for i, n in enumerate("ab")])


@query("fn_jamo", f"WITH {_KO} SELECT id, {_jamo_sql('a', 4352, 4449, 4519)} AS jamo FROM k")
def fn_jamo(spark, d):
    return korean_pairs(spark, d).select("id", X.jamo(F.col("a")).alias("jamo"))


@query("fn_edit", f"WITH {_KO} SELECT id, levenshtein({_jamo_sql('a', 33, 52, 72)}, {_jamo_sql('b', 33, 52, 72)})::INT AS distance FROM k")
def fn_edit(spark, d):
    return korean_pairs(spark, d).select("id", X.jamo_distance(F.col("a"), F.col("b")).alias("distance"))


_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({0}, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@query("fn_hash_embed", f"WITH t AS (SELECT doc_id AS id, unnest({_TOK.format('text')}) AS token FROM documents), h AS (SELECT id, {_FNV.format('token')} AS h, {_FNV.format(chr(39).join(['token || ', '#', '']))} AS g FROM t), e AS (SELECT id, h % 64 AS idx, CASE WHEN h % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS v FROM h UNION ALL SELECT id, g % 64, CASE WHEN h % 2 = 0 THEN 0.5 ELSE -0.5 END::DOUBLE FROM h), s AS (SELECT id, idx, sum(v) AS v FROM e GROUP BY 1, 2) SELECT id, idx::INT AS idx, {sql6('v / sqrt(sum(v * v) OVER (PARTITION BY id))', 'value')} FROM s WHERE v <> 0")
def fn_hash_embed(spark, d):
    return R.hash_vectors(chunks(spark, d)).withColumn("value", r6("value"))


@query("fn_rerank", f"{_LEX}, b AS (SELECT query_id, id, {sql6('score', 'score')} FROM s), t AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 4) SELECT query_id, id, {sql6(f'0.55 * score + 0.45 * greatest(0, coalesce({_COS}, 0))', 'score')} FROM t LEFT JOIN embeddings q ON q.vec_id = query_id LEFT JOIN embeddings v ON v.vec_id = t.id")
def fn_rerank(spark, d):
    hits = R.best(R.lexical_scores(asked(spark, d), chunks(spark, d)).select("query_id", "id", r6("score")), 4).drop("rank")
    return R.rerank(hits, _vectors(spark, d), _vectors(spark, d)).select("query_id", "id", r6("score"))
