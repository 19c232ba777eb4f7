"""Lexical and vector retrieval over text tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sanmaru.functions.numeric import half_up
from sanmaru.functions.text import FNV_PRIME, FNV_START, MASK, bm25_term, cosine, length_weight, tokens
from sanmaru.session import broadcast_upto, written

#: Queries of a block and vectors of a salt in one group of a vector join, vectors scored at once, and rows of a batch of scores.
MAX_QUERIES, SALT_VECTORS, TILE, ROWS_OUT = 1000, 1000, 64, 100_000
#: Texts whose tokens are hashed at once.
TEXTS = 500
#: Query tokens that may be broadcast.
ASKED_ROWS = 500_000
#: Postings of a query's rarest tokens that give its first threshold, for each of the ``k`` wanted; and what rounding may hide.
FIRST_POSTINGS, SLACK = 64, 2e-6
#: Documents whose whole scores give that threshold, for each of the ``k`` wanted.
PROBES = 8


def document_tokens(chunks: DataFrame) -> DataFrame:
    """``id, length, token``: one row for each distinct token of a chunk."""
    listed = chunks.select("id", tokens(F.col("text")).alias("tokens"))
    return listed.select("id", F.size("tokens").alias("length"), F.explode("tokens").alias("token"))


def idf(token_rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """``token, df, idf`` with ``ln(1 + N / (1 + df))``."""
    n = F.broadcast(chunks.agg(F.count(F.lit(1)).alias("n_")))
    return token_rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).crossJoin(n).withColumn("idf", F.log(1 + F.col("n_") / (1 + F.col("df")))).drop("n_")


def _fnv1a(words: list[str]) -> np.ndarray:
    """32-bit FNV-1a of the characters' codes of many words, one place of all words at a time."""
    sizes = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
    hashes = np.full(len(words), FNV_START, np.uint64)
    live = len(words)
    for at in range(int(sizes[0]) if len(words) else 0):
        while sizes[live - 1] <= at:
            live -= 1
        hashes[:live] = _fnv1a_step(hashes[:live], codes[starts[:live] + at])
    out = np.empty_like(hashes)
    out[order] = hashes
    return out


def _fnv1a_step(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return ((hashes ^ codes) * np.uint64(FNV_PRIME)) & np.uint64(MASK)


def _hash_sums(listed: pa.Array, dim: int) -> np.ndarray:
    """Lists of tokens by places: each token's signs at its two hashes, added up."""
    sizes = np.asarray(listed.value_lengths().fill_null(0), np.int64)
    named = listed.flatten().dictionary_encode()
    h = _fnv1a(named.dictionary.to_pylist())
    g, sign = _fnv1a_step(h, np.full(len(h), ord("#"), np.uint64)), np.where(h % np.uint64(2) == 0, 1.0, -1.0)
    rows, words = np.repeat(np.arange(len(sizes)), sizes) * dim, np.asarray(named.indices)
    sums = np.zeros(len(sizes) * dim)
    for hashes, weight in ((h, sign), (g, sign / 2)):
        sums += np.bincount(rows + (hashes % np.uint64(dim)).astype(np.int64)[words], weights=weight[words], minlength=len(sums))
    return sums.reshape(len(sizes), dim)


def hash_vectors(chunks: DataFrame, dim: int = 64) -> DataFrame:
    """``id, idx, value``: the places of each chunk's hashed vector that aren't 0, brought to length 1.

    As ``hash_embed`` has it, but tokens are hashed and added up in Arrow, once for each batch of texts; only a vector a
    chunk is shuffled, since rows of one ``id`` are added up. All sums are exact.
    """
    listed = chunks.select("id", tokens(F.col("text")).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                part = batch.slice(lo, TEXTS)
                sums = pa.array(_hash_sums(part.column(1), dim).ravel())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(np.arange(part.num_rows + 1, dtype=np.int32) * dim, sums)], names=["id", "sums"])

    schema = T.StructType([listed.schema["id"], T.StructField("sums", T.ArrayType(T.DoubleType()))])
    sums = listed.mapInArrow(run, schema).groupBy("id").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(dim)])
    norm = F.sqrt(reduce(add, [F.col(f"s{i}") * F.col(f"s{i}") for i in range(dim)]))
    places = sums.select("id", norm.alias("norm"), F.posexplode(F.array(*[f"s{i}" for i in range(dim)])).alias("idx", "v")).filter("v <> 0")
    return places.select("id", "idx", (F.col("v") / F.col("norm")).alias("value"))


def postings(queries: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The postings ``token, id, length, band`` of the queries' tokens, written once, and ``query_id, token, idf, df``.

    ``band`` is the block of a posting: documents of like lengths, so that a block's least length bounds all its scores.
    """
    asked = queries.select(F.col("id").alias("query_id"), F.explode(tokens(F.col("text"))).alias("token"))
    rows = document_tokens(chunks).join(broadcast_upto(asked.select("token").distinct(), ASKED_ROWS), "token", "left_semi")
    rows = written(rows.select("token", "id", "length", F.floor(F.log2("length") * 2).alias("band")))
    return rows, written(asked.join(idf(rows, chunks), "token"))


def lexical_scores(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id, id, score``: BM25 over common tokens, of all pairs that share one. Texts are tokenised once.

    Query tokens with their weights are broadcast up to ``ASKED_ROWS``, so that postings of frequent tokens stay where they
    are; document frequencies are counted for the queries' tokens alone.
    """
    rows, asked = postings(queries, chunks)
    joined = rows.join(broadcast_upto(asked, ASKED_ROWS), "token")
    return joined.groupBy("query_id", "id").agg(F.sum(bm25_term(F.col("idf"), F.col("length"))).alias("score"))


class Pruned(NamedTuple):
    """Steps of a pruned search: postings that give first thresholds, those of essential tokens, candidates, and exact scores."""

    first: DataFrame
    essential: DataFrame
    candidates: DataFrame
    scores: DataFrame


def pruned_scores(queries: DataFrame, chunks: DataFrame, k: int, least: float = 0.0) -> Pruned:
    """Exact scores of all documents that may be among a query's ``k`` best (or tie with them up to rounding) by MaxScore.

    A score is the sum of the weights of common tokens times a factor of the document's length. The rarest tokens of a
    query give some documents; the kth of their scores is a threshold that the kth best can't fall below (``least`` is another). Tokens
    whose greatest shares, the smallest first, add up to less than the threshold are not essential: a document that has
    no other token can't reach it. Blocks of postings whose length leaves too little, even with all tokens of the query,
    are passed over. Documents found by essential tokens stay candidates while their sum plus all that may be missing
    reaches the threshold; only for these the postings of other tokens are added.
    """
    rows, asked = postings(queries, chunks)
    blocks = written(rows.groupBy("token", "band").agg(F.count(F.lit(1)).alias("n"), F.min("length").alias("shortest")))
    bound = blocks.groupBy("token").agg(F.max(length_weight(F.col("shortest"))).alias("most"))
    by_query = W.partitionBy("query_id")
    rarest = by_query.orderBy("df", "token").rowsBetween(W.unboundedPreceding, W.currentRow)
    terms = asked.join(bound, "token").withColumn("share", F.col("idf") * F.col("most")).withColumn("all_", F.sum("idf").over(by_query)).withColumn("seen_", F.sum("df").over(rarest))
    terms = written(terms.withColumn("early", F.col("seen_") - F.col("df") < FIRST_POSTINGS * k).drop("seen_", "df", "most"))

    early = broadcast_upto(terms.filter("early").select("query_id", "token", "idf"), ASKED_ROWS)
    first = rows.join(early, "token").select("query_id", "id", "idf", "length")
    partial = first.groupBy("query_id", "id").agg(F.sum(bm25_term(F.col("idf"), F.col("length"))).alias("score"))
    probes = best(partial, PROBES * k).select("query_id", "id").join(terms.select("query_id", "token", "idf"), "query_id")  # PROBES * k documents a query
    probed = rows.join(broadcast_upto(written(probes), ASKED_ROWS), ["token", "id"])
    whole = probed.groupBy("query_id", "id").agg(F.sum(bm25_term(F.col("idf"), F.col("length"))).alias("score"))
    kth = best(whole, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
    threshold = kth.select("query_id", (F.greatest(F.when(F.col("n") == k, F.col("kth")).otherwise(0.0), F.lit(least)) - SLACK).alias("threshold"))

    small = by_query.orderBy("share", "token").rowsBetween(W.unboundedPreceding, W.currentRow)
    ruled = terms.join(threshold, "query_id").withColumn("essential", F.sum("share").over(small) >= F.col("threshold"))
    ruled = written(ruled.withColumn("rest", F.coalesce(F.sum(F.when(~F.col("essential"), F.col("idf"))).over(by_query), F.lit(0.0))))
    wanted = ruled.filter("essential").join(blocks, "token").filter(F.col("all_") * length_weight(F.col("shortest")) >= F.col("threshold"))
    wanted = wanted.select("query_id", "token", "band", "idf", "all_", "rest", "threshold")
    essential = rows.join(broadcast_upto(wanted, ASKED_ROWS), ["token", "band"]).filter(F.col("all_") * length_weight(F.col("length")) >= F.col("threshold"))
    sums = essential.groupBy("query_id", "id", "length").agg(F.sum("idf").alias("sum"), F.first("rest").alias("rest"), F.first("threshold").alias("threshold"))
    candidates = written(sums.filter((F.col("sum") + F.col("rest")) * length_weight(F.col("length")) >= F.col("threshold")))
    others = rows.join(broadcast_upto(ruled.filter("not essential").select("query_id", "token", "idf"), ASKED_ROWS), "token")
    found = broadcast_upto(candidates.select("query_id", "id"), ASKED_ROWS)
    added = others.join(found, ["query_id", "id"], "left_semi").select("query_id", "id", "length", F.col("idf").alias("sum"))
    whole = candidates.select("query_id", "id", "length", "sum").unionByName(added).groupBy("query_id", "id").agg((F.sum("sum") * F.first(length_weight(F.col("length")))).alias("score"))
    return Pruned(first, essential, candidates, whole)


def top_lexical(queries: DataFrame, chunks: DataFrame, k: int = 4, least: float = 0.0, digits: int = 6) -> DataFrame:
    """``query_id, id, score, rank``: the ``k`` best of each query with a rounded score over ``least``, ties to the smaller id."""
    scores = pruned_scores(queries, chunks, k, least).scores
    return best(scores.withColumn("score", half_up(F.col("score"), digits)), k, least)


def best(scores: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """The ``k`` best of each query by score, then identifier; limited before the shuffle."""
    rows = scores if least is None else scores.filter(F.col("score") > least)
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def normal_scores(scores: DataFrame) -> DataFrame:
    """Scores of each query as (v - min(v, 0)) / (max - min). They are written once, since they are read twice."""
    scores = written(scores)
    stats = scores.groupBy("query_id").agg(F.least(F.min("score"), F.lit(0.0)).alias("lo_"), F.greatest(F.max("score"), F.lit(1e-9)).alias("hi_"))
    return scores.join(broadcast_upto(stats, ASKED_ROWS), "query_id").withColumn("score", (F.col("score") - F.col("lo_")) / (F.col("hi_") - F.col("lo_"))).drop("lo_", "hi_")


def _fused(rows: DataFrame, lexical: Column, vector: Column, lexical_weight: float, vector_weight: float) -> DataFrame:
    """``query_id, id, score``: the weighted sum of two scores; a missing score is 0."""
    return rows.select("query_id", "id", (lexical_weight * F.coalesce(lexical, F.lit(0.0)) + vector_weight * F.coalesce(vector, F.lit(0.0))).alias("score"))


def hybrid(lexical: DataFrame, vectors: DataFrame, lexical_weight: float = 0.55, vector_weight: float = 0.45) -> DataFrame:
    """Weighted sum of two normalised score tables ``(query_id, id, score)``; a missing score is 0."""
    joined = normal_scores(lexical).withColumnRenamed("score", "l_").join(vectors.withColumnRenamed("score", "v_"), ["query_id", "id"], "full_outer")
    return _fused(joined, F.col("l_"), F.col("v_"), lexical_weight, vector_weight)


def hybrid_scores(queries: DataFrame, chunks: DataFrame, vector_queries: DataFrame, vectors: DataFrame, lexical_weight: float = 0.55, vector_weight: float = 0.45) -> DataFrame:
    """``query_id, id, score``: ``hybrid`` of the lexical scores of ``queries`` and the cosines of ``vector_queries``.

    Only queries that both sides ask have pairs to join. The pairs of all others keep their one score and aren't shuffled.
    """
    common = broadcast_upto(written(queries.select("id").join(vector_queries.select("id"), "id", "left_semi").distinct()), ASKED_ROWS)
    lexical = normal_scores(lexical_scores(queries, chunks))  # holds written scores, so reading it twice is cheap
    own = common.withColumnRenamed("id", "query_id")
    met = lexical.join(own, "query_id", "left_semi").withColumnRenamed("score", "l_")
    near = vector_scores(vector_queries.join(common, "id", "left_semi"), vectors).withColumnRenamed("score", "v_")
    both = met.join(near, ["query_id", "id"], "full_outer")
    words = lexical.join(own, "query_id", "left_anti")
    places = vector_scores(vector_queries.join(common, "id", "left_anti"), vectors)
    parts = (both, F.col("l_"), F.col("v_")), (words, F.col("score"), F.lit(0.0)), (places, F.lit(0.0), F.col("score"))
    fused = [_fused(rows, l, v, lexical_weight, vector_weight) for rows, l, v in parts]
    return fused[0].unionByName(fused[1]).unionByName(fused[2])


def _regular(column: pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors hold ``dim`` numbers and no nulls, and those as rows of doubles."""
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    sizes = np.asarray(lists.value_lengths().fill_null(-1))
    flat = lists.flatten()
    at = np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0))
    fine = sizes == dim
    if flat.null_count:
        fine[at[np.asarray(flat.is_null())]] = False
    return fine, np.asarray(flat.fill_null(0), np.float64)[fine[at]].reshape(int(fine.sum()), dim)


def _dots(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Dot products, vectors by queries; products are added in the order of components, so that sums don't depend on blocks."""
    out = np.zeros((len(v), len(q)))
    columns, product = np.ascontiguousarray(q.T), np.empty((min(TILE, len(v)), len(q)))
    for lo in range(0, len(v), TILE):
        tile, sums = v[lo : lo + TILE], out[lo : lo + TILE]
        for k in range(v.shape[1]):
            np.multiply(tile[:, k, None], columns[k], out=product[: len(tile)])
            sums += product[: len(tile)]
    return out


def _block_scores(vectors: pa.Table, queries: pa.Table, unit_length: bool, names: list[str]) -> pa.Table:
    """Scores of a block: those of vectors with nulls or of other lengths than a query's are null."""
    v_sizes, q_sizes = (t.column("vector").combine_chunks().value_lengths() for t in (vectors, queries))
    dims = sorted(set(pc.unique(v_sizes).drop_null().to_pylist()) & set(pc.unique(q_sizes).drop_null().to_pylist()))
    scores, known = np.zeros((vectors.num_rows, queries.num_rows)), np.zeros((vectors.num_rows, queries.num_rows), bool)
    with np.errstate(all="ignore"):
        for dim in dims:
            (v_fine, v), (q_fine, q) = _regular(vectors.column("vector"), dim), _regular(queries.column("vector"), dim)
            part = _dots(v, q)
            if unit_length:
                norms = np.sqrt(sum((v[:, k] * v[:, k] for k in range(dim)), np.zeros(len(v))))[:, None] * np.sqrt(sum((q[:, k] * q[:, k] for k in range(dim)), np.zeros(len(q))))
                part = np.where(norms == 0, 0.0, part / norms)
            scores[np.ix_(v_fine, q_fine)], known[np.ix_(v_fine, q_fine)] = part, True
    n, m = queries.num_rows, vectors.num_rows
    q_ids, v_ids = queries.column("query_id").combine_chunks(), vectors.column("id").combine_chunks()
    parts = []
    for lo in range(0, m, ROWS_OUT // n + 1):
        some = np.arange(lo, min(m, lo + ROWS_OUT // n + 1))
        score = pa.array(scores[some].ravel(), mask=None if known[some].all() else ~known[some].ravel())
        parts.append(pa.table([q_ids.take(pa.array(np.tile(np.arange(n), len(some)))), v_ids.take(pa.array(np.repeat(some, n))), score], names=names))
    return pa.concat_tables(parts)


def vector_scores(queries: DataFrame, vectors: DataFrame, unit_length: bool = True, within: str | None = None) -> DataFrame:
    """``query_id, id, score``: the cosine (or, unless ``unit_length``, the dot product) of all queries with all vectors.

    With ``within``, a column of both, only of queries and vectors that agree in it. Queries go to blocks of about
    ``MAX_QUERIES`` and vectors to salts of about ``SALT_VECTORS``, by their numbers in each value of ``within``; each block
    meets each salt in one group, whose scores are worked out in Arrow. So only vectors are shuffled, never pairs. The cosine
    with a vector of zeros is 0; pairs of vectors with nulls or of unlike lengths score null.
    """
    own = F.col(within) if within else F.lit(0)
    left = vectors.select("id", F.col("vector").cast("array<double>").alias("vector"), own.alias("own_"))
    right = queries.select(F.col("id").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"), own.alias("own_"))
    asked = right.groupBy("own_").agg(F.ceil(F.count(F.lit(1)) / MAX_QUERIES).cast("int").alias("blocks_"))
    found = left.groupBy("own_").agg(F.ceil(F.count(F.lit(1)) / SALT_VECTORS).cast("int").alias("salts_"))
    sizes = broadcast_upto(written(asked.join(found, "own_")), ASKED_ROWS)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left, right = left.join(sizes, "own_"), right.join(sizes, "own_")
    left = left.withColumn("salt_", F.pmod(F.xxhash64("id"), F.col("salts_")).cast("int")).withColumn("block_", numbers("blocks_"))
    right = right.withColumn("block_", F.pmod(F.xxhash64("query_id"), F.col("blocks_")).cast("int")).withColumn("salt_", numbers("salts_"))
    names = ["query_id", "id", "score"]

    def run(v: pa.Table, q: pa.Table) -> pa.Table:
        return _block_scores(v, q, unit_length, names) if v.num_rows and q.num_rows else pa.table([q.column("query_id").slice(0, 0), v.column("id").slice(0, 0), pa.array([], pa.float64())], names=names)

    schema = T.StructType([T.StructField("query_id", right.schema["query_id"].dataType), T.StructField("id", left.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    group = ["own_", "block_", "salt_"]
    return left.drop("blocks_", "salts_").groupBy(*group).cogroup(right.drop("blocks_", "salts_").groupBy(*group)).applyInArrow(run, schema)


def rerank(hits: DataFrame, query_vectors: DataFrame, vectors: DataFrame, own: float = 0.55, remote: float = 0.45) -> DataFrame:
    """``query_id, id, score`` of ``hits`` fused with the cosines of remote vectors ``(id, vector)``; none or a negative one counts 0."""
    q = query_vectors.select(F.col("id").alias("query_id"), F.col("vector").alias("q_"))
    joined = hits.join(q, "query_id", "left").join(vectors.select("id", F.col("vector").alias("v_")), "id", "left")
    near = F.greatest(F.lit(0.0), F.coalesce(cosine(F.col("q_"), F.col("v_")), F.lit(0.0)))
    return joined.select("query_id", "id", (own * F.col("score") + remote * near).alias("score"))


def context(hits: DataFrame, most: int = 1200) -> DataFrame:
    """Each query's hits in rank order while their joined lengths fit."""
    used = F.sum(F.length("text")).over(W.partitionBy("query_id").orderBy("rank"))
    return hits.withColumn("used", used).filter(F.col("used") <= most)


def any_word(name: Column, words: list[str]) -> Column:
    """Whether a name without blanks contains one of the words."""
    flat = F.regexp_replace(name, " ", "")
    return F.exists(F.array(*map(F.lit, words)), lambda w: flat.contains(w))
