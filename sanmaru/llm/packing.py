"""Packing documents into sequences: shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

import heapq
import os
import re
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sanmaru.llm.common import cut, running_starts, tidy
from sanmaru.llm.hashing import slices

#: Words whose ids a Python worker remembers; the memory this takes is bounded, whatever the input.
CACHE_WORDS = 1_200_000
#: Pieces of one length that one task ranks, on average.
RANK_ROWS = 256
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


#: Between an ASCII letter and ASCII punctuation, where the tokenizer always splits.
BOUNDARY = re.compile(rb"(?<=[a-z])(?=[!-/:-@\[-`{-~])")


def words_of(text: str | None) -> list[bytes]:
    """Parts of a text whose ids, one after the other, are the ids of the text.

    White space and the step from a letter to punctuation always split. ASCII letters are lower-cased first, as the
    tokenizer does, unless the text holds combining marks (composition comes before case) or may hold special tokens.
    """
    b = (text or "").encode()
    if b"<|" in b or b"\xcc" in b or b"\xcd" in b:
        return b.split()
    return BOUNDARY.sub(b" ", b.lower()).split()


class WordIds:
    """Token ids of texts, word by word, with a cache of words that is emptied when it is full."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.start, self.length, self.flat = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)
        self.used = 0

    def _ids(self, words: list[str]) -> list[list[int]]:
        plain = [w.isascii() and w.isalpha() and w.islower() for w in words]
        rest = iter(self.tokenizer.encode_batch_fast([w for w, p in zip(words, plain, strict=True) if not p], add_special_tokens=False))
        model = self.tokenizer.model.tokenize  # all that is left to do for a run of small ASCII letters
        return [[t.id for t in model(w)] if p else next(rest).ids for w, p in zip(words, plain, strict=True)]

    def learn(self, words: set[bytes]) -> None:
        new = list(words.difference(self.index))
        if not new:
            return
        got = self._ids([w.decode() for w in new])
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        total, first = int(sizes.sum()), len(self.index)
        while first + len(new) > len(self.start):
            self.start, self.length = np.concatenate([self.start, self.start]), np.concatenate([self.length, self.length])
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.index.update(zip(new, range(first, first + len(new)), strict=True))
        self.start[first : first + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.length[first : first + len(new)] = sizes
        self.flat[self.used : self.used + total] = np.fromiter((i for ids in got for i in ids), np.uint32, total)
        self.used += total

    def encode(self, words: list[bytes]) -> np.ndarray:
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        size = self.length[at]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def no_words(tokenizer_path: str) -> WordIds:
    """An empty cache."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return WordIds(Tokenizer.from_file(tokenizer_path))


def known_words(tokenizer_path: str) -> WordIds:
    """The cache of this Python worker, which later tasks of the worker find filled."""
    held = sys.modules.setdefault("sanmaru_worker_words", types.ModuleType("sanmaru_worker_words")).__dict__
    if tokenizer_path not in held:
        held[tokenizer_path] = no_words(tokenizer_path)
    return held[tokenizer_path]


def token_pieces(docs: DataFrame, tokenizer_path: str, width: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS, keep_words: bool = True) -> DataFrame:
    """The pieces of each document, each of ``width`` ids but the last: ``doc_id, start, length, ids_crc32, doc_tokens``.

    With ``keep_words``, words that a task has learned stay in its Python worker; else nothing of them outlives the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_words(tokenizer_path) if keep_words else no_words(tokenizer_path)
        for batch in slices(batches, column=1):
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            known.learn(set().union(*words))
            rows: list[tuple] = []
            for doc_id, doc in zip(batch.column(0).to_pylist(), words, strict=True):
                ids = np.append(known.encode(doc), np.uint32(end_id)).astype("<u4")
                rows += [(doc_id, at, min(width, len(ids) - at), zlib.crc32(ids[at : at + width].tobytes()), len(ids)) for at in range(0, len(ids), width)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            if len(known.index) > cache_words or known.used > 16 * cache_words:
                known.clear()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(tidy(run), PIECES)


def plan_packs(histogram: dict[int, int], width: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns ``(count, [(length, times), ...])`` that place every length.

    Lengths go longest first. Each goes to the pattern with the most space, if it fits, as often as there are such
    packs; what fits nowhere opens packs that hold as many of it as they can.
    """
    space: dict[int, list[tuple[int, tuple]]] = {}  # free ids: patterns (count, lengths)
    heap: list[int] = []

    def put(free: int, count: int, held: tuple) -> None:
        if free not in space:
            space[free] = []
            heapq.heappush(heap, -free)
        space[free].append((count, held))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while heap and not space.get(-heap[0]):
                space.pop(-heapq.heappop(heap), None)
            free = -heap[0] if heap else 0
            if free < length:
                most = width // length
                if full := left // most:
                    put(width - most * length, full, ((length, most),))
                if rest := left % most:
                    put(width - rest * length, 1, ((length, rest),))
                break
            count, held = space[free].pop()
            took = min(count, left)
            if took < count:
                put(free, count - took, held)
            same = held[-1][0] == length
            put(free - length, took, (*held[:-1], (length, held[-1][1] + 1)) if same else (*held, (length, 1)))
            left -= took
    return [(count, list(held)) for free in sorted(space) for count, held in space[free]]


def pack_documents(docs: DataFrame, tokenizer_path: str, width: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS, keep_words: bool = True) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its ids, then ``end_id``; null and empty texts are that id alone. Documents over ``width`` ids are
    cut into pieces of ``width`` and a rest. Pieces of equal length are exchangeable: each gets a rank among its length,
    and the plan says which ranks a pattern takes. Repeated rows are packed as often as they occur. An empty table gives
    no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = cut(token_pieces(docs, tokenizer_path, width, end_id, id_col, text_col, cache_words, keep_words))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``width`` rows

    taken, first, slots = dict.fromkeys(histogram, 0), 0, {n: [] for n in histogram}
    for count, held in plan_packs(histogram, width):
        offset = 0
        for length, times in held:
            slots[length].append((taken[length], times, first, offset))
            taken[length] += count * times
            offset += length * times
        first += count
    rows = [(n, histogram[n], s) for n, s in slots.items()]
    plan = F.broadcast(spark.createDataFrame(rows, "length long, n long, slots array<struct<rank:long,times:long,first:long,offset:long>>"))  # as long as the histogram

    dealt = pieces.join(plan.select("length", "n"), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.ceil(F.col("n") / RANK_ROWS)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("size"))
    starts = running_starts(sizes, ["length"], "bucket", "size")
    ranked = dealt.withColumn("no", F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "start")) - 1).join(starts, ["length", "bucket"]).withColumn("rank", F.col("no") + F.col("before"))
    placed = ranked.join(plan.drop("n"), "length").withColumn("slot", F.element_at(F.filter("slots", lambda s: s["rank"] <= F.col("rank")), -1)).withColumn("nth", F.col("rank") - F.col("slot.rank"))
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("slot.first") + F.floor(F.col("nth") / F.col("slot.times"))).alias("sequence_id"),
        (F.col("slot.offset") + F.col("nth") % F.col("slot.times") * F.col("length")).alias("offset"),
    )
