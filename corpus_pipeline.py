"""Corpus pipeline: quality filter, exact dedup, near-duplicate removal, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that its predecessor kept and returns the columns of
``documents``; the last returns the packing of what is left. Stages decide about rows, not identifiers: null and shared
identifiers and repeated rows are rows like all others. SQL can't express the classifier, the draws of the mix and
the tokenizer, so there is no oracle; the tests compare the stages with brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sanmaru.llm.common import WORD, broadcast_upto, cut, shared_dir, table
from sanmaru.llm.exact_dedup import exact_dedup
from sanmaru.llm.jaccard_join import jaccard_components
from sanmaru.llm.mixing import mix_draws, shuffled
from sanmaru.llm.packing import pack_documents
from sanmaru.llm.quality import fit_sample, keep_accepted
from sanmaru.llm.queries import tokenizer_path

def _free(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``docs`` has it."""
    while name in docs.columns:
        name += "_"
    return name


def _key(text_sha256: Column, *others: str) -> Column:
    """What tells rows apart: identifier (null is a value like others), text and the ``others``."""
    return F.to_json(F.struct("doc_id", *others, text_sha256.alias("sha_")))


def _sha() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)


def _once(rows: DataFrame, key: str, repeated: DataFrame) -> DataFrame:
    """``rows`` with one row for each ``key`` of ``repeated``, the first as JSON, which also orders maps and arrays."""
    if not repeated.limit(1).count():
        return rows
    first = _free(rows, "first_")
    number = F.row_number().over(W.partitionBy(key).orderBy(F.to_json(F.struct(*[c for c in rows.columns if c != key]))))
    one = rows.join(repeated, key, "left_semi").withColumn(first, number).filter(F.col(first) == 1).select(rows.columns)
    return rows.join(repeated, key, "left_anti").select(rows.columns).union(one)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows whose text the classifier rejects.

    Each row is judged by its own text, so null, shared and repeated identifiers change nothing; null and empty texts get
    the score of the bias. An empty table stays empty; other columns pass as they are.
    """
    return keep_accepted(docs, fit_sample(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of equal texts: that with the largest identifier; null and empty texts are equal.

    A row without an identifier stays if no row of its group has one; of rows repeated with that identifier one stays.
    An empty table stays empty; other columns pass as they are.
    """
    key = _free(docs, "row_key_")
    found = exact_dedup(docs, keep="max").filter("group_size > 1").select(_key(F.col("text_sha256")).alias(key), (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("stays"), "kept")
    found = cut(found)
    out, repeated = found.filter("not stays").select(key), found.filter("stays and not kept").select(key).distinct()
    return _once(docs.withColumn(key, _key(_sha())).join(out, key, "left_anti"), key, repeated).select(docs.columns)


def _numbered(texts: DataFrame, width: int = 64) -> DataFrame:
    """``texts(doc_id, text, sha)`` with ``node``, a number that is equal where ``sha`` is and different where that differs.

    Numbers that several digests share (at most those of ``width`` bits) are drawn again, until there are none.
    """
    texts = texts.withColumn("node", F.pmod(F.xxhash64("sha"), F.lit(1 << width)) if width < 63 else F.xxhash64("sha"))
    while (shared := cut(texts.groupBy("node").agg(F.min("sha").alias("x"), F.max("sha").alias("y")).filter("x <> y").select("node"))).limit(1).count():
        shared = shared.withColumn("again", F.lit(True))
        texts = texts.join(broadcast_upto(shared, 1_000_000), "node", "left").withColumn("node", F.when(F.col("again"), F.xxhash64("node", "sha")).otherwise(F.col("node"))).drop("again")
    return texts


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest identifier of each group of near copies, one without only if no other has any.

    Texts are the nodes of the link graph, told apart by SHA-256; texts without shingles all stay. Of rows repeated with
    the identifier that stays, one stays. An empty table stays empty; other columns pass as they are.
    """
    key = _free(docs, "row_key_")
    named = _numbered(docs.select("doc_id", "text", _sha().alias("sha")))
    nodes = cut(jaccard_components(named, id_col="node").filter("n_shingles > 0").select(F.col("doc_id").alias("node"), F.col("component_id").alias("group")).distinct())
    rows = named.select(_key(F.col("sha")).alias(key), "node", "doc_id").groupBy(key, "node", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    placed = cut(rows.join(nodes, "node").select(key, "group", "doc_id", "n"))
    stay = placed.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key)).alias("s")).select(f"s.{key}")
    out, repeated = placed.join(stay, key, "left_anti").select(key), placed.filter("n > 1").select(key)
    return _once(docs.withColumn(key, _key(_sha())).join(out, key, "left_anti"), key, repeated).select(docs.columns)


def mix_by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each draw of the mix, in its shuffled order; a document that is only taken in part keeps its first words.

    Rows equal in all columns are exchangeable: one of them takes the draws of all. Null and shared identifiers are
    drawn like others; texts without words are in no mix. An empty table stays empty; ``n_chars`` follows the text.
    """
    key, drawn = _free(docs, "row_key_"), _free(docs, "draw_")
    rows = docs.withColumn(key, _key(_sha(), *[c for c in docs.columns if c not in ("doc_id", "text")]))
    draws = cut(mix_draws(rows, id_col=key).filter("words > 0").select(F.col("doc_id").alias(key), "copy", F.struct("size", "words", "shard", "part", "order_key").alias(drawn)))
    size, words = F.col(f"{drawn}.size"), F.col(f"{drawn}.words")
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), 0), 1, words.cast("int")), " ")
    mixed = _once(rows, key, draws.filter("copy > 1").select(key).distinct()).join(draws.drop("copy"), key)
    mixed = mixed.withColumn("text", F.when(words < size, first).otherwise(F.col("text")))
    mixed = mixed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else mixed
    return shuffled(mixed, drawn).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 token ids. Workers remember fewer words than they would alone and none after a task, since they
    serve other stages too, and Spark deals tasks to all workers that it keeps, which may be more than its cores."""
    return pack_documents(docs, tokenizer_path(), cache_words=300_000, keep_words=False)


STAGES = [("quality", quality_filter), ("exact_dedup", drop_exact_copies), ("jaccard_join", drop_near_copies), ("mixing", mix_by_source), ("packing", pack)]

#: The classifier, the draws and the tokenizer have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
