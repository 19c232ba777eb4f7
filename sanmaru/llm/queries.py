"""Queries of the operators in this package, and the SQL that some of them are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sanmaru.llm import sql
from sanmaru.llm.centroids import cluster_vectors
from sanmaru.llm.common import table
from sanmaru.llm.exact_dedup import exact_dedup
from sanmaru.llm.html_extract import extract_pages
from sanmaru.llm.jaccard_join import jaccard_components
from sanmaru.llm.mixing import mix_documents
from sanmaru.llm.packing import pack_documents
from sanmaru.llm.quality import fit_sample, score_quality
from sanmaru.llm.quotes import link_quotations
from sanmaru.llm.secrets import scan_secrets
from sanmaru.llm.simhash import simhash_components
from sanmaru.llm.topk_search import top_k
from sanmaru.llm.url_filter import judge_urls
from sanmaru.llm.vector_codes import code_vectors

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_sample(docs, table(spark, sf_dir, "labels")))


def op5_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return judge_urls(table(spark, sf_dir, "pages"), outcomes).drop("bad_mean")


def op7_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op9_link_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(table(spark, sf_dir, "conversations"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_vectors(table(spark, sf_dir, "embeddings"))


def op12_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (
        op1_html_extract, op2_mix_sources, op3_exact_dedup, op4_quality_classifier, op5_top_k_search, op6_url_filter,
        op7_pack_documents, op8_jaccard_join, op9_link_quotations, op10_secret_scan, op11_vector_codes,
        op12_simhash_groups, op13_centroid_clusters, pipeline,
    )
    return {f.__name__: f for f in listed}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLE)
