"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only.

The permuted documents of a source, pass after pass, are cut into blocks of equal numbers of words; a document lies in
the block of its first word. A binary tree over the output shards splits the exact block quotas of all sources: each
node draws, without replacement, how many blocks of each source go left. Each leaf then takes its blocks from a
permutation of every source's blocks, so that first passes and repeats meet in all shards. What a document gives to the mix is what lies in blocks that a leaf owns, and a random key orders the
draws of each shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sanmaru.llm.common import WORD, cut, running_starts

#: Documents of a permutation bucket, on average; bounds what one task ranks, however large the source.
BUCKET_ROWS = 1024
#: Blocks of the whole mix at most (besides one for each source), so that quotas are small at any size.
MAX_BLOCKS = 1 << 16
#: Sources at most; their sizes and quotas are metadata that the driver holds.
MAX_SOURCES = 100_000
#: Words of a part of a shard that one task shuffles, on average.
PART_WORDS = 20_000_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """``sizes(source, source_size, source_docs)`` with ``source_id, weight, target``.

    Sources rank by code point, null last; ``weights`` repeat. Water filling: with sources by cap/weight, the level is
    that of the first source which it doesn't exceed; sources below stop at their cap.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("source_id", F.row_number().over(by_name) - 1).withColumn("weight", F.get(cycle, F.col("source_id") % len(weights)))
    ranked = ranked.withColumn("most", cap * F.col("source_size")).withColumn("total", share * F.sum("source_size").over(W.partitionBy()))
    before = W.orderBy(F.col("most") / F.col("weight"), "source_id").rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy(F.col("most") / F.col("weight"), "source_id").rowsBetween(0, W.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level)
    level_here = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("source_id"), F.col("level").alias("level")))).over(W.partitionBy())["level"]
    return ranked.withColumn("target", F.least(F.col("most"), F.coalesce(level_here, F.lit(0.0)) * F.col("weight"))).drop("most", "total", "level")


def split_quotas(quota: list[int], shards: int, seed: int) -> list[list[int]]:
    """Quotas of each shard: the tree halves the shards, and each node draws exactly what goes left."""
    rng, out = np.random.default_rng(seed), []
    stack = [(np.array(quota, np.int64), shards)]
    while stack:
        q, k = stack.pop()
        if k == 1:
            out.append(q.tolist())
            continue
        left = rng.multivariate_hypergeometric(q, int(q.sum()) * (k // 2) // k, method="marginals")
        stack += [(q - left, k - k // 2), (left, k // 2)]
    return out


def mix_draws(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17, shards: int | None = None, max_sources: int = MAX_SOURCES) -> DataFrame:
    """The draws of the mix: ``doc_id, source, mark, copy, size, source_size, target, pass, words, shard, part, order_key``.

    Each document has a row for each pass it is in, or one with 0 words and no shard; ``words`` under ``size`` means that
    only its first words are taken (at most one document of each source). A source's words add up to its target, rounded.
    ``mark`` is a hash of the text; ``copy`` numbers rows that agree in identifier, source and text. ``part`` splits large
    shards for the shuffle. More than ``max_sources`` sources, whose quotas the driver holds, are refused. Null texts have size 0; sources null, empty or of size 0 get what
    the rule gives them (target 0 at size 0). Reruns agree for the same rows and seed. An empty table gives no rows.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text_col).alias("mark"))
    rows = rows.groupBy("doc_id", "source", "size", "mark").agg(F.count(F.lit(1)).alias("rows"))  # equal rows meet as counts
    rows = cut(rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("rows"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    sources = cut(source_targets(sizes, weights, share, cap))

    listed = sources.select("source_id", "target").orderBy("source_id").limit(max_sources + 1).collect()
    if len(listed) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    total = sum(r.target for r in listed)
    block_words = max(1 << 10, -(-int(total) // MAX_BLOCKS))
    quota = [-(-round(r.target) // block_words) for r in listed]
    shards = shards or max(1, min(1024, sum(quota) // 64))
    owners, at = [], [0] * len(quota)
    permuted = [np.random.default_rng([seed, s]).permutation(n).tolist() for s, n in enumerate(quota)]
    for k, part in enumerate(split_quotas(quota, shards, seed)):
        for s, n in enumerate(part):
            owners += [(s, b, k) for b in permuted[s][at[s] : at[s] + n]]
            at[s] += n
    shard_of = F.broadcast(spark.createDataFrame(owners, "source_id int, block long, shard int"))  # at most MAX_BLOCKS + max_sources rows

    rows = rows.join(F.broadcast(sources), rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])  # at most max_sources rows
    rows = rows.withColumn("key", F.xxhash64("doc_id", "mark", "copy", F.lit(seed))).withColumn("bucket", F.pmod(F.xxhash64("key"), F.ceil(F.col("source_docs") / BUCKET_ROWS)))
    buckets = rows.groupBy("source_id", "bucket").agg(F.sum("size").alias("bucket_size"))
    starts = running_starts(buckets, ["source_id"], "bucket", "bucket_size").withColumnRenamed("before", "start")
    within = W.partitionBy("source_id", "bucket").orderBy("key", "doc_id", "mark", "copy").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["source_id", "bucket"]).withColumn("before", F.col("before") + F.col("start"))

    goal = F.floor(F.col("target") + 0.5)
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0))
    rest = goal - F.col("passes") * F.col("source_size")
    rows = rows.withColumn("passes", passes).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before"))))
    last = F.when((F.col("part") > 0) | (F.col("passes") == 0), F.col("passes")).otherwise(F.col("passes") - 1)
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = rows.withColumn("words", F.when(F.col("pass") < F.col("passes"), F.col("size")).otherwise(F.col("part")))
    rows = rows.withColumn("block", F.floor((F.col("pass") * F.col("source_size") + F.col("before")) / block_words))
    owned = rows.join(shard_of, ["source_id", "block"], "left").withColumn("shard", F.when(F.col("words") > 0, F.col("shard")))
    order, parts = F.xxhash64("key", "pass", F.lit("order")), max(1, -(-int(total) // shards // PART_WORDS))
    words = F.when(F.col("shard").isNotNull(), F.col("words")).otherwise(F.lit(0))
    return owned.select("doc_id", "source", "mark", "copy", "size", "source_size", "target", "pass", words.alias("words"), "shard", F.pmod(order, F.lit(parts)).alias("part"), order.alias("order_key"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """One row for each document: ``doc_id, size, source_size, target, taken, shards``; options as in ``mix_draws``."""
    draws = mix_draws(docs, **options).groupBy("doc_id", "source", "mark", "copy", "size", "source_size", "target")
    return draws.agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list("shard")).alias("shards")).drop("source", "mark", "copy")


def shuffled(draws: DataFrame, inside: str = "") -> DataFrame:
    """Draws, with whatever columns were joined to them, in the order of the mix: by shard, in each by its random keys.

    ``inside`` names the struct that holds the columns of the draws, if one does.
    """
    shard, part, key = (f"{inside}.{c}" if inside else c for c in ("shard", "part", "order_key"))
    return draws.repartition(shard, part).sortWithinPartitions(shard, part, key)


def write_mix(draws: DataFrame, path: str) -> None:
    """Write the draws that take words by shard, each shard in its own random order."""
    shuffled(draws.filter("words > 0")).write.partitionBy("shard").parquet(path)
