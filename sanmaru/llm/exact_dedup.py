"""Exact dedup by a log-structured merge index of digests. DataFrame functions only.

A memtable (a batch of rows) is flushed as a run: its digests in order, each once, with the identifier that stays, and
a Bloom filter. A new memtable is looked up in the older runs: only digests that a run's filter lets through are joined
with the run. Full levels are compacted into a run of the next level, which keeps one identifier of each digest. Texts of
hits are compared byte by byte before they are dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sanmaru.llm.common import broadcast_bytes, broadcast_upto, cut, shared_dir

#: Digests of hits that may be broadcast: 32 bytes each, so about 50 MB with overhead.
HITS_BROADCAST = 500_000
#: Runs of a level before it is compacted, and memtables that a table is read in.
FANOUT, MEMTABLES = 2, 2
#: Filters: bits of a block (its size in bytes is that of Spark's bitmaps), bits set for a digest, bits of a filter for each.
BLOCK_BITS, HASHES, BITS_PER_DIGEST = 32_768, 4, 12


class Run:
    """Sorted entries ``(digest, keep_id, n)`` and, from the first lookup on, the filter ``(block, bits)`` of their digests."""

    def __init__(self, entries: DataFrame):
        self.entries = entries
        self._filter: tuple[DataFrame, int] | None = None

    def filter(self) -> tuple[DataFrame, int]:
        """The filter and its number of blocks."""
        if self._filter is None:
            blocks = max(1, self.entries.count() * BITS_PER_DIGEST // BLOCK_BITS)
            built = cut(build_filter(self.entries.select("digest"), blocks))
            held = broadcast_bytes(built, "bits")
            self._filter = (built if held is None else held, blocks)
        return self._filter


def _block(digest: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(blocks))


def _positions(digest: str) -> list[Column]:
    return [F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(BLOCK_BITS)) for k in range(1, HASHES + 1)]


def build_filter(digests: DataFrame, blocks: int) -> DataFrame:
    """A blocked Bloom filter ``(block, bits)`` of ``digests(digest)``: every digest sets its bits in one block."""
    bits = digests.select(_block("digest", blocks).alias("block"), F.explode(F.array(*_positions("digest"))).alias("at"))
    return bits.groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits"))


def may_hold(digests: DataFrame, run: Run) -> DataFrame:
    """The rows of ``digests(digest, ...)`` that ``run`` may hold by its filter: all that it holds, and few others."""
    bits, blocks = run.filter()
    near = digests.withColumn("block", _block("digest", blocks)).join(bits, "block")
    found = F.lit(True)
    for at in _positions("digest"):
        byte = F.conv(F.hex(F.substring(F.col("bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        found = found & (F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1)
    return near.filter(found).drop("block", "bits")


class DigestIndex:
    """Levels of runs. ``add`` flushes a memtable and tells which of its digests the index has seen more than once."""

    def __init__(self, spark: SparkSession, path: str | None = None, keep: str = "min", fanout: int = FANOUT):
        """``keep``: which identifier of a digest stays, ``min`` or ``max``."""
        if keep not in ("min", "max"):
            raise ValueError("keep is min or max")
        self.spark, self.keep, self.fanout = spark, F.min if keep == "min" else F.max, fanout
        self.path = path or f"{shared_dir(spark).rstrip('/')}/digest-index-{uuid.uuid4().hex}"
        self.levels: list[list[Run]] = []

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        out = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(out)
        return self.spark.read.schema(df.schema).parquet(out)

    def _run(self, entries: DataFrame, level: int) -> Run:
        return Run(self._write(entries.sortWithinPartitions("digest"), f"l{level}"))

    def _merged(self, runs: list[Run]) -> DataFrame:
        """Entries of all runs, each digest once; partial aggregation comes before the shuffle."""
        parts = runs[0].entries
        for r in runs[1:]:
            parts = parts.unionByName(r.entries)
        return parts.groupBy("digest").agg(self.keep("keep_id").alias("keep_id"), F.sum("n").alias("n"))

    def add(self, rows: DataFrame) -> DataFrame:
        """Flush ``rows(digest, id)`` as a run and return ``digest`` of the hits: repeated in it or held by an older run."""
        run = self._run(rows.groupBy("digest").agg(self.keep("id").alias("keep_id"), F.count(F.lit(1)).alias("n")), 0)
        hits = run.entries.filter("n > 1").select("digest")
        for older in [r for level in self.levels for r in level]:
            hits = hits.unionByName(may_hold(run.entries.select("digest"), older).join(older.entries.select("digest"), "digest", "left_semi"))
        hits = self._write(hits.distinct(), "hits")
        self.levels = self.levels or [[]]
        self.levels[0].append(run)
        level = 0
        while len(self.levels[level]) >= self.fanout:  # compaction
            merged = self._run(self._merged(self.levels[level]), level + 1)
            self.levels[level] = []
            if len(self.levels) == level + 1:
                self.levels.append([])
            self.levels[level + 1].append(merged)
            level += 1
        return hits

    def entries(self) -> DataFrame:
        """``digest, keep_id, n`` of all that was added."""
        runs = [r for level in self.levels for r in level]
        return runs[0].entries if len(runs) == 1 else self._merged(runs)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", normalise: Column | None = None, memtables: int = MEMTABLES) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null texts count as empty, so null and empty texts form one group. Texts are equal when their normalised bytes
    are (``normalise`` defaults to no change). Of equal texts the row with the ``keep`` identifier stays; a row with
    a null identifier stays only if its group has no other identifier; of repeated rows with one identifier one
    stays. An empty table gives an empty result; other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(normalise if normalise is not None else F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("body"))
    narrow = cut(rows.select("id", "digest", F.pmod(F.xxhash64("id", "digest"), F.lit(memtables)).alias("memtable")))
    index = DigestIndex(spark, keep=keep)
    hits = None
    for k in range(memtables):
        new = index.add(narrow.filter(F.col("memtable") == k).select("digest", "id"))
        hits = new if hits is None else hits.unionByName(new)
    hits = cut(hits.distinct())
    found = index.entries().join(broadcast_upto(hits, HITS_BROADCAST), "digest", "left_semi").withColumnRenamed("n", "group_size")
    bodies = rows.join(broadcast_upto(hits, HITS_BROADCAST), "digest", "left_semi").groupBy("digest").agg(F.min("body").alias("lo"), F.max("body").alias("hi"))
    proof = bodies.select("digest", F.when(F.col("lo") == F.col("hi"), F.lit(True)).otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("boolean")).alias("equal"))
    proven = broadcast_upto(cut(found.join(proof, "digest").filter("equal").drop("equal")), HITS_BROADCAST)  # written: beyond the bound the join may split hot digests
    placed = narrow.join(proven, "digest", "left").select(
        "id", "digest", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size")
    )
    # of rows that agree in identifier and text, one is kept: they are told apart by their number alone
    staying = placed.filter("group_size > 1 and id <=> keep_id").groupBy("digest", "id", "keep_id", "group_size").agg(F.count(F.lit(1)).alias("rows"))
    twins = cut(staying.filter("rows > 1"))
    alike = broadcast_upto(twins.select(F.col("digest").alias("d"), F.col("id").alias("i")), HITS_BROADCAST)
    once = placed.join(alike, (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("i")), "left_anti").withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))
    again = twins.withColumn("no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).withColumn("kept", F.col("no") == 1)
    both = once.unionByName(again.drop("rows", "no"))
    return both.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
