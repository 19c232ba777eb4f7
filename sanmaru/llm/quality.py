"""Quality classifier: supervised subword embeddings, trained by numpy stochastic gradient descent.

A document is the average of the vectors of its words, its pairs of neighbouring words and its runs of three to five
characters, all hashed to one table, and a softmax layer reads that average. A pair is hashed by the difference of its
words' hashes, so that all pairs of equal words share a row. The table and the layer are learned together. Since all steps after the lookup are linear, scoring needs one number for each table row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sanmaru.llm.common import cut, give_back, tidy
from sanmaru.llm.hashing import mixed, run_hashes, slices

#: Rows of the embedding table, as a power of two, and their size.
TABLE_BITS, DIM = 17, 16
#: Labelled documents to learn from, at most, and the longest of them in characters.
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 20_000
EPOCHS, RATE, SEED = 5, 0.5, 11
#: Lengths of character runs, and characters that are read at once (a longer word counts as several).
RUNS, CHUNK = (3, 4, 5), 1 << 16
_BASE, _SPREAD = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def _blank(c: np.ndarray) -> np.ndarray:
    return (c == 32) | ((c >= 9) & (c <= 13))


def features(text: str) -> Iterator[np.ndarray]:
    """Table rows of all words, word pairs and character runs, with repeats, in parts of about ``CHUNK`` characters."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    shift, lo, last = np.uint32(32 - TABLE_BITS), 0, None
    while lo < len(codes):
        hi = min(len(codes), lo + CHUNK)
        if hi < len(codes):
            gaps = np.flatnonzero(_blank(codes[lo:hi]))
            hi = lo + int(gaps[-1]) + 1 if len(gaps) else hi
        found, first = [], max(0, lo - max(RUNS) + 1)
        part = codes[first:hi]
        run = part + np.uint32(1)
        for n in range(2, max(RUNS) + 1):
            if len(part) < n:
                break
            run = run[: len(part) - n + 1] * _BASE + part[n - 1 :]
            if n in RUNS:  # runs that end in this part
                found.append((run[max(0, lo - first - n + 1) :] * _SPREAD + np.uint32(n << 20)) >> shift)
        part = codes[lo:hi]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ~_blank(part), [False]]).astype(np.int8)))
        if len(edges):
            words = run_hashes(part.astype(np.uint64) + np.uint64(1), edges[::2], edges[1::2])
            found.append((words >> np.uint64(64 - TABLE_BITS)).astype(np.uint32))
            words = words if last is None else np.concatenate([[last], words])
            found.append((mixed(words[1:] - words[:-1]) >> np.uint64(64 - TABLE_BITS)).astype(np.uint32))
            last = words[-1]
        if found:
            yield np.concatenate(found).astype(np.int64)
        lo = hi


@dataclass
class QualityModel:
    """``weight`` is each table row's share in the logit of label 1, ``bias`` the rest of it."""

    weight: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        total, count = 0.0, 0
        for rows in features(text or ""):
            total, count = total + float(self.weight[rows].sum(dtype=np.float64)), count + len(rows)
        logit = self.bias + total / max(1, count)
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def step(table: np.ndarray, layer: np.ndarray, bias: np.ndarray, rows: np.ndarray, shares: np.ndarray, label: int, pace: float) -> None:
    """One step of stochastic gradient descent, in place, on a document of the table ``rows`` with their ``shares``.

    Rows of a document share one average, so their steps are longer by the root of their number.
    """
    hidden = shares @ table[rows]
    logits = layer @ hidden + bias
    error = np.exp(logits - logits.max())
    error /= error.sum()
    error[label] -= 1
    back = layer.T @ error
    layer -= pace * np.outer(error, hidden)
    bias -= 0.1 * pace * error
    table[rows] -= (pace * len(rows) ** 0.5) * shares[:, None] * back[None, :]


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> QualityModel:
    """Learn from labelled texts, other labels than 0 and 1 left out; with one label only, the score is that label's share."""
    known = [(t or "", label) for t, label in zip(texts, labels, strict=True) if label in (0, 1)]
    labels = [label for _, label in known]
    share = (sum(labels) + 1) / (len(labels) + 2)
    if len(set(labels)) < 2:
        return QualityModel(np.zeros(1 << TABLE_BITS, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    docs = []
    for t, _ in known:
        rows, counts = np.unique(np.concatenate([*features(t), np.zeros(0, np.int64)]), return_counts=True)
        docs.append((rows, (counts / max(1, counts.sum())).astype(np.float32)))
    table = rng.uniform(-1 / DIM, 1 / DIM, (1 << TABLE_BITS, DIM)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (2, DIM)).astype(np.float32), np.log(np.array([1 - share, share], np.float32))
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            step(table, layer, bias, *docs[i], labels[i], rate * (1 - done / steps))
            done += 1
    return QualityModel((table @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]))


def fit_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> QualityModel:
    """Fit on at most ``rows`` labelled documents of at most ``chars`` characters, taken by a hash of the identifier.

    Rows whose ``crc32(doc_id)`` is divisible by 5 are held out.
    """
    known = labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    usable = docs.filter((F.crc32(F.col("doc_id").cast("string")) % 5 != 0) & (F.length("text") <= chars))
    order = F.xxhash64("doc_id")
    ids = usable.select("doc_id").join(known, "doc_id").distinct().orderBy(order, "doc_id").limit(rows)  # narrow rows until the sample is known
    picked = usable.select("doc_id", "text").join(F.broadcast(cut(ids)), "doc_id").orderBy(order, "doc_id", "text").limit(rows).collect()
    model = fit([r.text for r in picked], [int(r.quality) for r in picked])
    give_back()  # the driver's, which lasts longer than the fit
    return model


def score_quality(docs: DataFrame, model: QualityModel, accept: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: ``doc_id, held_out, score, predicted``, from the whole text.

    Null and empty texts get the score of the bias alone. ``held_out`` is false for a null identifier. Repeated rows
    give repeated rows, an empty table none; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2^TABLE_BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in slices(batches, column=1):
            scores = [m.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(tidy(run), "doc_id long, score double")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def keep_accepted(docs: DataFrame, model: QualityModel, accept: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose own text the model accepts; identifiers play no part in it."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)  # 2^TABLE_BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in slices(batches, column=at):
            yield batch.filter(pa.array([m.score(t) >= accept for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
