"""Vector codes: parts of vectors become numbers of codebook entries, found by filtering entries as a VA-file does.

Each coordinate of a codebook's entries is quantised to a few bits, which name a cell of its axis. For a part, tables
hold its least and greatest squared distance to each cell of each axis; adding them up by an entry's cells bounds the
distance to that entry. Only entries whose lower bound doesn't exceed the least upper bound get an exact distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sanmaru.llm.common import broadcast_upto, cut, tidy
from sanmaru.llm.vectors import integers, matrix

PARTS, ENTRIES, ROUNDS, BITS = 16, 64, 2, 3
#: Vectors coded at once.
CHUNK = 512
#: Labels whose sums may be broadcast.
LABELS_BROADCAST = 1_000_000


class CellFile:
    """The entries of one codebook with their coordinates quantised to cells of ``bits`` bits."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        cells = 1 << bits
        ranked = np.sort(entries, axis=0)
        starts = ranked[np.arange(cells) * len(entries) // cells]  # cells start at quantiles of the entries; equal ones stay empty
        self.cell = np.stack([np.searchsorted(starts[:, d], entries[:, d], side="right") - 1 for d in range(entries.shape[1])], axis=1)
        self.low, self.high = np.zeros_like(starts), np.zeros_like(starts)
        for d in range(entries.shape[1]):
            for c in np.unique(self.cell[:, d]):
                inside = entries[self.cell[:, d] == c, d]
                self.low[c, d], self.high[c, d] = inside.min(), inside.max()

    def candidates(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of parts and of the entries that bounds can't tell apart, in order."""
        least, most = np.zeros((len(parts), len(self.entries)), np.int64), np.zeros((len(parts), len(self.entries)), np.int64)
        for d in range(parts.shape[1]):
            x = parts[:, d : d + 1]
            below, above = self.low[None, :, d] - x, x - self.high[None, :, d]
            least += (np.maximum(0, np.maximum(below, above)) ** 2)[:, self.cell[:, d]]
            most += (np.maximum(np.abs(below), np.abs(above)) ** 2)[:, self.cell[:, d]]
        return np.nonzero(least <= most.min(axis=1, keepdims=True))

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part (ties: the lower number) and its squared distance."""
        row, entry = self.candidates(parts)
        distance = ((parts[row] - self.entries[entry]) ** 2).sum(axis=1)
        order = np.lexsort((entry, distance, row))
        first = order[np.searchsorted(row, np.arange(len(parts)))]  # rows stay in place, and each has candidates
        return entry[first], distance[first]


def _code(x: np.ndarray, files: list[CellFile], width: int) -> tuple[np.ndarray, np.ndarray]:
    found = [f.nearest(x[:, p * width : (p + 1) * width]) for p, f in enumerate(files)]
    return np.stack([e for e, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = CHUNK) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(lo, rows) for lo in range(0, batch.num_rows, rows))


def _moved(ready: DataFrame, held, width: int) -> DataFrame:
    """``slot, n, s0, s1, ...``: how many parts each entry got and the sums of their components; ``slot`` numbers parts, then entries."""
    names = [f"s{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [CellFile(b) for b in held.value]
        size = len(files[0].entries)
        n, sums = np.zeros(PARTS * size, np.int64), np.zeros((PARTS * size, width), np.int64)
        for batch in _chunks(batches):
            x = matrix(batch.column(0), PARTS * width)
            slots = (_code(x, files, width)[0] + np.arange(PARTS) * size).ravel()
            n += np.bincount(slots, minlength=len(n))
            np.add.at(sums, slots, x.reshape(-1, width))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), *(pa.array(sums[used, i]) for i in range(width))], names=["slot", "n", *names])

    schema = ", ".join(f"{c} long" for c in ("slot", "n", *names))
    return ready.select("x").mapInArrow(tidy(run), schema).groupBy("slot").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names))


def _smallest_ids(ready: DataFrame, most: int = ENTRIES) -> list[int]:
    """The smallest distinct identifiers, without a shuffle of all: passes over them take the next ``most`` rows, repeats included."""
    found: list[int] = []
    while len(found) < most:
        rest = ready.filter(F.col("vec_id") > found[-1]) if found else ready.filter("vec_id is not null")
        rows = rest.select("vec_id").orderBy("vec_id").limit(most).collect()
        if not rows:
            break
        found += sorted({r.vec_id for r in rows})
    return found[:most]


def code_vectors(vectors: DataFrame, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row for each kept row: ``vec_id, code, error, label_error, codebooks_sha256``.

    Rows whose vector is null or holds a null or non-finite component are dropped. Components become
    ``floor(scale * component)``. Vectors are cut into 16 equal parts; shorter vectors, empty ones too, count as ending in
    zeros up to the longest length, raised to a multiple of 16. Codebooks start as the parts of the 64 smallest distinct
    identifiers (of repeated ones the smallest vector; fewer if there are fewer) and move in two rounds; null identifiers
    start none, but are coded like others. If no row has an identifier, all codebooks start with one entry of zeros.
    ``label_error`` adds up errors of equal labels, nulls together. Repeated rows are coded as often as they occur; an empty
    table gives no rows; other columns are ignored. Vectors whose distances may not fit 64-bit integers are refused.
    The driver holds the codebooks alone: 64 entries of a vector's length, whatever the number of vectors.
    """
    spark = vectors.sparkSession
    ready = cut(integers(vectors, scale, id_col, vector_col, F.col(label_col).alias("label")))
    size = ready.agg(F.max(F.size("x")).alias("dim"), F.max(F.array_max(F.transform("x", lambda e: F.abs(e.cast("double"))))).alias("most")).first()
    width = max(1, -(-(size.dim or 0) // PARTS))
    if 4 * (size.most or 0) ** 2 * width * PARTS >= 2.0**62:
        raise ValueError("distances may not fit 64-bit integers")
    firsts = ready.filter(F.col("vec_id").isin(_smallest_ids(ready))).groupBy("vec_id").agg(F.min("x").alias("x"))
    seeds = firsts.orderBy("vec_id").collect()  # at most ENTRIES vectors
    start = matrix(pa.array([r.x for r in seeds] or [[]], pa.list_(pa.int64())), PARTS * width)
    books = [start[:, p * width : (p + 1) * width].copy() for p in range(PARTS)]
    for _ in range(ROUNDS):
        for r in _moved(ready, spark.sparkContext.broadcast(books), width).collect():  # at most PARTS * ENTRIES rows
            part, entry = divmod(r.slot, len(start))
            books[part][entry] = [r[2 + i] // r.n for i in range(width)]
    digest = hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()
    held = spark.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [CellFile(b) for b in held.value]
        for batch in _chunks(batches):
            entries, distances = _code(matrix(batch.column(2), PARTS * width), files, width)
            codes = [row.tobytes().hex() for row in entries.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(distances.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    kind = ready.schema["label"].dataType.simpleString()
    coded = cut(ready.select("vec_id", "label", "x").mapInArrow(tidy(run), f"vec_id long, label {kind}, code string, error long"))
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(broadcast_upto(cut(totals), LABELS_BROADCAST), F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
