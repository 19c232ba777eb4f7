"""N-gram Jaccard join as an exact join in the metric space of shingle sets.

The distance is one minus the Jaccard similarity. Unrelated documents are at distance 1 from each other, so document
pivots alone would tell nothing about them. The first pivots are therefore single shingles: a document is as near to
each of its shingles, and ties go to the shingle that comes first in one global order (frequent ones last). The window
within which a document at distance 0.2 or less may have its own first common shingle is the first fifth of its set, so
a document is replicated to those regions. Regions give the pairs that share as many shingles as that bound asks for;
the connected groups of such pairs are closed under links. Every group is split, again and again, by document pivots: a
document goes to the Voronoi cell of its nearest pivot, or to the remainder if none is near, and the triangle inequality
says to which other cells it must be replicated. Documents that a pivot links stand for each other, so that inside a cell
only the others need to be joined with them and among themselves: the latter are the regions of the next level. Groups
that fit one task are split there, larger ones by Spark; what pivots can't split of those is joined by blocks of like sizes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sanmaru.llm.common import broadcast_upto, cut, tidy
from sanmaru.llm.components import components
from sanmaru.llm.hashing import mixed, run_hashes, slices

#: Words of a shingle; links at similarity of NUM/DEN or more.
WORDS, NUM, DEN = 5, 4, 5
#: A shingle region of so many documents is large: frequent shingles go last in the order, large regions become stars.
REGION = 64
#: Frequent shingles held at most (8 bytes each); beyond, only more frequent ones count.
MAX_FREQUENT = 1_000_000
#: Identifiers that may be broadcast to pick rows of a scan.
IDS_BROADCAST = 1_000_000
#: Documents and shingles of a group or block that one task joins at a time.
BLOCK, BLOCK_SHINGLES = 256, 1 << 21
#: Documents of a region that pivots do not split.
LEAF = 1
#: Document pivots of a group, levels of such splits, rows of a group that meet one copy of its pivots.
PIVOTS, LEVELS, SALT_ROWS = 32, 5, 2048
#: Bytes of a text that are hashed at once (a longer word stands alone).
CHUNK = 1 << 20
_rng = np.random.default_rng(20)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word of a text, in order; A-Z count as a-z."""
    whole, parts, lo = (text or "").encode().lower(), [], 0
    while lo < len(whole):
        hi = min(len(whole), lo + CHUNK)
        while hi < len(whole) and not (whole[hi] == 32 or 9 <= whole[hi] <= 13):
            hi += 1
        b = np.frombuffer(whole, np.uint8, hi - lo, lo)
        inside = (b != 32) & ((b < 9) | (b > 13))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        if len(edges):
            parts.append(run_hashes(_BYTE[b], edges[::2], edges[1::2]))
        lo = hi
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; of the whole word sequence, if it is shorter than one."""
    words = word_hashes(text)
    if not len(words):
        return np.zeros(0, np.int64)
    size = min(WORDS, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        out += words[i : len(words) - size + 1 + i] * _PLACE[i]
    return np.unique(mixed(out).view(np.int64))


def _window(n: int) -> int:
    """How many first shingles of a set of ``n`` are kept: at least a fifth and one."""
    return min(n, n // 4 + 2)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    sizes = np.fromiter(map(len, parts), np.int32, len(parts))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)])))


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    return [flat[e - s : e] for e, s in zip(ends, sizes, strict=True)]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, column=1):
        sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
        sums = [[int(mixed(s.view(np.uint64) + np.uint64(k)).sum(dtype=np.uint64).view(np.int64)) for s in sets] for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64()), _lists([s[: _window(len(s))] for s in sets])], names=["id", "n", "d1", "d2", "keys"])


def _whole_sets(docs: DataFrame, picked: DataFrame, extra: str, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter) -> DataFrame:
    """``id, extra, keys`` of the documents in ``picked(id, extra)``; ``keys`` are whole sets, or what ``then`` makes of them.

    ``then`` runs in the same Python worker, so that a task doesn't take two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=1):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), _lists([shingle_set(t) for t in batch.column(1).to_pylist()])], names=["id", extra, "keys"])

    found = docs.join(broadcast_upto(picked, IDS_BROADCAST), "id").select("id", "text", F.col(extra).cast("long").alias(extra))
    return found.mapInArrow(tidy(lambda batches: then(run(batches))), f"id long, {extra} long, keys array<long>")


def _pairs_in_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by ``key``: pairs ``a < b`` of each small region with the number of common keys they need, or
    stars ``(least, b, -1)`` of large ones. Holds at most a batch and the begun region, of a large one its least id."""
    held = np.zeros((0, 4), np.int64)
    star: tuple[int, int] | None = None  # key and least id of a large region that goes on

    def emit(rows: list[np.ndarray]) -> pa.RecordBatch:
        out = np.concatenate([*rows, np.zeros((0, 3), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(out[:, i]) for i in range(3)], names=["a", "b", "need"])

    def close(rows: np.ndarray) -> list[np.ndarray]:
        found = []
        key = rows[:, 0]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.repeat(np.diff(np.concatenate([first, [len(rows)]])), np.diff(np.concatenate([first, [len(rows)]])))
        large = rows[sizes >= REGION]
        if len(large):
            at = np.flatnonzero(np.concatenate([[True], large[1:, 0] != large[:-1, 0]]))
            least = np.repeat(np.minimum.reduceat(large[:, 1], at), np.diff(np.concatenate([at, [len(large)]])))
            found.append(np.stack([least, large[:, 1], np.full(len(large), -1)], axis=1))
        rows = rows[(sizes > 1) & (sizes < REGION)]
        for gap in range(1, REGION):
            x, y = rows[:-gap], rows[gap:]
            same = x[:, 0] == y[:, 0]
            if not same.any():
                break
            x, y = x[same], y[same]
            fits = (DEN * np.minimum(x[:, 2], y[:, 2]) >= NUM * np.maximum(x[:, 2], y[:, 2])) & (x[:, 1] != y[:, 1])
            x, y = x[fits], y[fits]
            overlap = -(-NUM * (x[:, 2] + y[:, 2]) // (NUM + DEN))
            need = np.maximum(1, overlap + np.minimum(x[:, 3] - x[:, 2], y[:, 3] - y[:, 2]))
            found.append(np.stack([np.minimum(x[:, 1], y[:, 1]), np.maximum(x[:, 1], y[:, 1]), need], axis=1))
        return found

    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)
        found = []
        if star is not None:
            more = int(np.searchsorted(rows[:, 0], star[0], side="right"))
            ids = rows[:more, 1]
            found.append(np.stack([np.full(more, star[1]), ids, np.full(more, -1)], axis=1))
            rows = rows[more:]
            if len(rows):
                star = None
        if len(rows):
            rows = np.concatenate([held, rows])
            cut_at = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            held = rows[cut_at:]
            found += close(rows[:cut_at]) if cut_at else []
            if len(held) >= REGION:
                star = (int(held[0, 0]), int(held[:, 1].min()))
                found += close(held)
                held = held[:0]
        yield emit(found)
    if len(held):
        yield emit(close(held))


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections."""
    if len(left) * len(right) <= 64:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left])
    sets = [*left, *right]
    sizes = [len(s) for s in sets]
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    row, keep = np.repeat(np.arange(len(sets)), sizes), shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out, width = np.zeros((len(left), len(right)), np.float32), 4096
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        i, j = np.searchsorted(column, [lo, lo + width])
        dense = np.zeros((len(sets), width), np.float32)
        dense[row[i:j], column[i:j] - lo] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return np.rint(out).astype(np.int64)


def _linked(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    both = _overlaps(left, right)
    union = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :] - both
    return (both > 0) & (DEN * both >= NUM * union)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Roots of ``0..n-1`` joined by pairs, and pairs that suffice to join them."""
    root, used = list(range(n)), []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        i, j = x, y
        while root[i] != i:
            root[i] = i = root[root[i]]
        while root[j] != j:
            root[j] = j = root[root[j]]
        if i != j:
            root[max(i, j)] = min(i, j)
            used.append((x, y))
    for i in range(n):
        while root[i] != root[root[i]]:
            root[i] = root[root[i]]
    return np.array(root), used


def metric_links(sets: list[np.ndarray]) -> tuple[list[tuple[int, int]], int]:
    """Links that connect all that links connect among ``sets``, and into how many regions pivots split them.

    The rules of cells, rings and windows are those of ``_near_pivots``. Each entry of the stack is a region: its rows, and
    which of them are inner, that is, still need all their links found here.
    """
    r, slack = 1 - NUM / DEN, 1e-9
    links: list[tuple[int, int]] = []
    regions = 0
    stack = [(np.arange(len(sets)), np.ones(len(sets), bool), 0)]

    def joined(left: np.ndarray, right: np.ndarray) -> None:
        if len(left) and len(right):
            a, b = np.nonzero(_linked([sets[i] for i in left], [sets[i] for i in right]))
            links.extend((int(left[i]), int(right[j])) for i, j in zip(a, b, strict=True) if left[i] != right[j])

    while stack:
        rows, inner, level = stack.pop()
        if len(rows) < 2 or not inner.any():
            continue
        if len(rows) <= LEAF or level >= LEVELS:
            joined(rows[inner], rows)
            continue
        order = rows[np.argsort(mixed(rows.astype(np.uint64) * np.uint64(LEVELS + 1) + np.uint64(level)))]
        pivots: list[int] = []
        for p in order[:PIVOTS].tolist():
            both = _overlaps([sets[p]], [sets[q] for q in pivots])[0] if pivots else np.zeros(0)
            if all(1 - n / (len(sets[p]) + len(sets[q]) - n) > 4 * r for n, q in zip(both, pivots, strict=True)):
                pivots.append(p)
        both = _overlaps([sets[i] for i in rows], [sets[p] for p in pivots])
        union = np.array([len(sets[i]) for i in rows])[:, None] + np.array([len(sets[p]) for p in pivots])[None, :] - both
        far, hit = 1 - both / union, (both > 0) & (DEN * both >= NUM * union)
        home, least = far.argmin(axis=1), far.min(axis=1)
        window = np.minimum(least + 2 * r, 4 * r) + slack
        for j, p in enumerate(pivots):
            here, near = hit[:, j] | (far[:, j] <= window), far[:, j] <= 2 * r + slack
            links.extend((int(i), p) for i in rows[hit[:, j]] if i != p)
            joined(rows[hit[:, j]], rows[here & near & ~hit[:, j]])
            rest = here & ~hit[:, j]
            stack.append((rows[rest], (inner & (home == j) & (least <= 3 * r))[rest], level + 1))
            regions += 1
        rest = least > 2 * r - slack
        if rest.any():
            stack.append((rows[rest], (inner & (least > 3 * r))[rest], level + 1))
            regions += 1
    return links, regions


def _by_group(batches: Iterator[pa.RecordBatch], batches_column: int) -> Iterator[list[tuple]]:
    """Rows of a partition sorted by its first column, group by group."""
    group: list[tuple] = []
    for batch in slices(batches, column=batches_column):
        columns = [_arrays(c) if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if group and group[0][0] != row[0]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def _join_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact join inside each group, by pivots: ``id, component``."""
    for group in _by_group(batches, 2):
        group.sort(key=lambda r: r[1])
        ids, sets = np.array([r[1] for r in group], np.int64), [r[2] for r in group]
        links, _ = metric_links(sets)
        links += [(i, i + 1) for i in np.flatnonzero(ids[1:] == ids[:-1]).tolist()]  # rows of one identifier
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        root, _ = _forest(len(ids), a, b)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["id", "component"])


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact join of rows ``pair, side, id, keys``: side 0 with side 1, or with itself where a pair has one side only.

    Gives links that suffice to connect what the join connects.
    """
    for group in _by_group(batches, 3):
        sides = [[r for r in group if r[1] == side] for side in (0, 1)]
        left, right = sides[0], sides[1] or sides[0]
        if not left:
            continue
        a, b = np.nonzero(_linked([r[3] for r in left], [r[3] for r in right]))
        _, used = _forest(len(left) + len(right), a, b + len(left))
        links = {(min(x, y), max(x, y)) for x, y in ((left[i][2], right[j - len(left)][2]) for i, j in used) if x != y}
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*sorted(links), strict=True)], names=["a", "b"])


def _near_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of documents, from rows ``label, salt, pivot, id, inner, keys`` sorted by the first three; proposed pivots
    (``pivot`` is their number, else PIVOTS) stand first. Those further than 4r from all before are taken, so that few
    documents stand in several cells.

    Gives ``label, cell, id, inner, ring, keys``. ``ring`` is 0 where the cell's pivot links the document (then ``pivot_id``
    names it), 1 where a document of ring 0 may be linked with it, 2 further out; ``cell`` -1 is the remainder. A document
    stays inner in its own cell only. With d the least distance to a pivot and r the greatest of a link, it is at home
    with its nearest pivot if d <= 3r, else in the remainder; it is replicated to pivots within min(d + 2r, 4r), and to
    the remainder if d > 2r. So what is linked with a document that is inner in a cell stands in that cell, too.
    """
    r, slack, group = 1 - NUM / DEN, 1e-9, None
    pivots: list[tuple[int, np.ndarray]] = []
    for batch in slices(batches, 64, column=5):
        out: list[tuple] = []
        rows = list(zip(*[batch.column(i).to_pylist() for i in range(5)], _arrays(batch.column(5)), strict=True))
        at = 0
        while at < len(rows):
            if rows[at][:2] != group:
                group, pivots = rows[at][:2], []
            if rows[at][2] < PIVOTS:
                keys = np.array(rows[at][5])
                both = _overlaps([keys], [p for _, p in pivots])[0] if pivots else np.zeros(0)
                if all(1 - n / (len(keys) + len(p) - n) > 4 * r for n, (_, p) in zip(both, pivots, strict=True)):
                    pivots.append((rows[at][3], keys))
                at += 1
                continue
            end = at
            while end < len(rows) and rows[end][:2] == group:
                end += 1
            sets = [row[5] for row in rows[at:end]]
            both = _overlaps(sets, [p for _, p in pivots])
            union = np.array([len(x) for x in sets])[:, None] + np.array([len(p) for _, p in pivots])[None, :] - both
            far, linked = 1 - both / union, (both > 0) & (DEN * both >= NUM * union)
            for (label, _, _, doc, inner, x), d, hit in zip(rows[at:end], far, linked, strict=True):
                home, least = int(d.argmin()), float(d.min())
                if least > 2 * r - slack:
                    out.append((label, -1, doc, inner and least > 3 * r, 2, 0, x))
                for j in np.flatnonzero(hit | (d <= min(least + 2 * r, 4 * r) + slack)).tolist():
                    ring = 0 if hit[j] else 1 if d[j] <= 2 * r + slack else 2
                    out.append((label, pivots[j][0], doc, inner and j == home and least <= 3 * r, ring, pivots[j][0] if hit[j] else 0, x))
            at = end
        if out:
            cols = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)] + [_lists(list(cols[6]))], names=["label", "cell", "id", "inner", "ring", "pivot_id", "keys"])


def _sizes(rows: DataFrame) -> DataFrame:
    """``label, n, parts``: documents of each group and into how many blocks they go."""
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.size("keys")) / BLOCK_SHINGLES))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), parts.alias("parts"))


def _blocks(rows: DataFrame) -> DataFrame:
    """Pairs of blocks of ``rows(label, band, id, keys)``: of one band and of neighbouring bands of a label."""
    sizes = _sizes(rows.withColumn("label", F.xxhash64("label", "band"))).select(F.col("label").alias("l"), F.col("parts").cast("long").alias("parts"))
    sizes = broadcast_upto(cut(sizes), IDS_BROADCAST)
    own = rows.join(sizes, F.xxhash64("label", "band") == F.col("l")).withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.col("parts"))).drop("l", "parts")
    to = own.withColumn("to", F.explode(F.array(F.col("band"), F.col("band") - 1, F.col("band") + 1)))
    to = to.join(sizes, F.xxhash64("label", "to") == F.col("l")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    mine, other = F.struct(F.col("band").alias("c"), F.col("block").alias("b")), F.struct(F.col("to").alias("c"), F.col("other").alias("b"))
    sided = to.select(F.xxhash64("label", F.least(mine, other), F.greatest(mine, other)).alias("pair"), F.when(mine <= other, 0).otherwise(1).cast("long").alias("side"), "id", "keys")
    return sided.repartition("pair").sortWithinPartitions("pair").mapInArrow(tidy(_join_blocks), "a long, b long")


def _across(rows: DataFrame) -> DataFrame:
    """Links between the two sides of each label of ``rows(label, side, id, keys)``, by pairs of blocks."""
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.size("keys")) / BLOCK_SHINGLES))
    sizes = rows.groupBy("label", "side").agg(parts.alias("parts"))
    sizes = sizes.groupBy("label").agg(F.max(F.when(F.col("side") == 0, F.col("parts"))).alias("p0"), F.max(F.when(F.col("side") == 1, F.col("parts"))).alias("p1")).filter("p0 is not null and p1 is not null")
    own = rows.join(broadcast_upto(cut(sizes), IDS_BROADCAST), "label")
    block = F.pmod(F.xxhash64("id", F.lit("block")), F.when(F.col("side") == 0, F.col("p0")).otherwise(F.col("p1")))
    to = own.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("side") == 0, F.col("p1")).otherwise(F.col("p0")) - 1)))
    first = F.col("side") == 0
    pair = F.xxhash64("label", F.when(first, F.col("block")).otherwise(F.col("other")), F.when(first, F.col("other")).otherwise(F.col("block")))
    return to.select(pair.alias("pair"), "side", "id", "keys").repartition("pair").sortWithinPartitions("pair").mapInArrow(tidy(_join_blocks), "a long, b long")


def _large_groups(sets: DataFrame) -> DataFrame:
    """Links that connect each large group of ``sets(label, id, keys)``: levels of cells around pivots, then blocks."""
    rows, found = sets.withColumn("inner", F.lit(True)), []
    band = F.floor(F.log(F.size("keys").cast("double")) / F.log(F.lit(DEN / NUM)) + 1e-9).cast("long")  # linked sizes are of one band or of neighbours
    for level in range(LEVELS):
        sizes = cut(_sizes(rows))
        small = broadcast_upto(sizes.filter("parts <= 1 and n > 1").select("label"), IDS_BROADCAST)
        done = rows.join(small, "label", "left_semi").select(F.col("label").alias("pair"), F.lit(0).cast("long").alias("side"), "id", "keys")
        found.append(cut(done.repartition("pair").sortWithinPartitions("pair").mapInArrow(tidy(_join_blocks), "a long, b long")))
        split = sizes.filter("parts > 1").select("label", "n", F.ceil(F.col("n") / SALT_ROWS).alias("salts"))
        if not split.limit(1).count():
            return _union(found)
        held = cut(rows.join(broadcast_upto(split, IDS_BROADCAST), "label"))
        picks = held.groupBy("label", F.pmod(F.xxhash64("id", F.lit(level)), F.lit(PIVOTS)).alias("pivot")).agg(F.min(F.struct(F.xxhash64("id", F.lit(level), F.lit("least")), "id"))["id"].alias("id"))
        pivots = held.join(picks, ["label", "id"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
        columns = ["label", "salt", "pivot", "id", "inner", "keys"]
        both = held.withColumn("salt", F.pmod(F.xxhash64("id", F.lit("salt")), F.col("salts"))).withColumn("pivot", F.lit(PIVOTS).cast("long")).select(columns).union(pivots.withColumn("pivot", F.col("pivot").cast("long")).select(columns))
        cells = both.repartition("label", "salt").sortWithinPartitions("label", "salt", "pivot").mapInArrow(tidy(_near_pivots), "label long, cell long, id long, inner boolean, ring long, pivot_id long, keys array<long>")
        cells = cut(cells.withColumn("of", F.col("label")).withColumn("label", F.xxhash64("label", "cell")))
        found.append(cells.filter("ring = 0 and pivot_id <> id").select(F.least("pivot_id", "id").alias("a"), F.greatest("pivot_id", "id").alias("b")))
        found.append(cut(_across(cells.filter("ring < 2").select("label", F.col("ring").alias("side"), "id", "keys"))))
        rest = cells.filter("ring > 0")
        # a group whose inner documents hardly get fewer is left to blocks
        tight = rest.groupBy("label", "of").agg(F.count(F.lit(1)).alias("rest"), F.count_if("inner").alias("own")).join(split.select(F.col("label").alias("of"), "n"), "of")
        stuck = broadcast_upto(cut(tight.filter(f"rest > {BLOCK} and rest > 0.7 * n and own > 0").select("label")), IDS_BROADCAST)
        empty = broadcast_upto(cut(tight.filter("own = 0").select("label")), IDS_BROADCAST)
        found.append(cut(_blocks(rest.join(stuck, "label", "left_semi").select("label", band.alias("band"), "id", "keys"))))
        rows = rest.join(stuck, "label", "left_anti").join(empty, "label", "left_anti").select("label", "id", "keys", "inner")
    found.append(_blocks(rows.select("label", band.alias("band"), "id", "keys")))
    return _union(found)


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return whole


def candidate_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """``picked(label, id, keys)`` of ``docs(id, text)``: groups that hold all links, with whole sets; before it what else the
    join needs: all sizes, sets without copies, copies, and how copies are told.
    """
    spark = docs.sparkSession
    sketches = cut(docs.mapInArrow(tidy(_sketches), "id long, n long, d1 long, d2 long, keys array<long>"))
    narrow = sketches.select("id", "n", "d1", "d2")

    same = narrow.filter("n > 0 and id is not null").groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows")
    copies = cut(narrow.join(broadcast_upto(cut(same), IDS_BROADCAST), ["n", "d1", "d2"]).filter("id <> rep").select("id", "rep", "n", "d1", "d2").distinct())
    left_out = broadcast_upto(copies.drop("rep"), IDS_BROADCAST)
    sets = sketches.filter("n > 0 and id is not null").join(left_out, ["id", "n", "d1", "d2"], "left_anti").select("id", "n", "keys")

    counts = cut(sets.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= REGION))
    at = REGION
    while (frequent := counts.filter(F.col("df") >= at)).count() > MAX_FREQUENT:
        at *= 2
    held = spark.sparkContext.broadcast(np.sort(np.array([r.key for r in frequent.select("key").toLocalIterator()], np.int64)))

    def is_frequent(x: np.ndarray) -> np.ndarray:
        f = held.value
        return f[np.minimum(np.searchsorted(f, x), len(f) - 1)] == x if len(f) else np.zeros(len(x), bool)

    def rare_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows without frequent shingles; empty where the rest is too short to be a window."""
        for batch in slices(batches, 2048, column=2):
            n, keys = batch.column(1).to_numpy(), _arrays(batch.column(2))
            rest = [x[~is_frequent(x)] for x in keys]
            rest = [x if len(x) > m // DEN else x[:0] for x, m in zip(rest, n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(rest)], names=["id", "n", "keys"])

    def reordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows of whole sets, frequent shingles last."""
        for batch in slices(batches, column=2):
            keys = _arrays(batch.column(2))
            first = [np.concatenate([x[~f], x[f]])[: _window(len(x))] for x, f in ((x, is_frequent(x)) for x in keys)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in keys], pa.int64()), _lists(first)], names=["id", "n", "keys"])

    windows = sets.mapInArrow(tidy(rare_first), "id long, n long, keys array<long>")
    short = cut(windows.filter("size(keys) = 0").select("id", F.lit(0).cast("long").alias("n")).distinct())
    windows = windows.filter("size(keys) > 0").unionByName(_whole_sets(docs, short, "n", reordered))
    rows = windows.select(F.explode("keys").alias("key"), "id", "n", F.size("keys").cast("long").alias("kept"))
    regions = rows.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_pairs_in_regions), "a long, b long, need long")
    pairs = cut(regions.groupBy("a", "b", "need").agg(F.count(F.lit(1)).alias("common")))

    unseen = pairs.filter("need = -1").groupBy("b").agg(F.sum("common").alias("unseen"))  # keys whose regions are large
    unseen = broadcast_upto(cut(unseen), IDS_BROADCAST)
    near = pairs.filter("need > 0").join(unseen, "b", "left").join(unseen.select(F.col("b").alias("a"), F.col("unseen").alias("unseen_a")), "a", "left")
    near = near.filter(F.col("common") >= F.col("need") - F.least(F.coalesce("unseen", F.lit(0)), F.coalesce("unseen_a", F.lit(0))))
    groups = components(near.select("a", "b").union(pairs.filter("need = -1 and a <> b").select("a", "b")))

    picked = cut(_whole_sets(docs, groups.select("id", "label"), "label").select("label", "id", "keys"))
    return narrow, sets, copies, left_out, picked


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_shingles, component_id``.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Null, empty and blank texts have no shingles and
    link with nothing. Equal sets are joined once. Rows that share an identifier are one node of the link graph; rows
    with a null identifier link with nothing and have a null component. An empty table gives no rows; other columns
    are ignored. Shingles are compared by 64-bit hashes.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    narrow, sets, copies, left_out, picked = candidate_groups(docs)
    large = broadcast_upto(cut(_sizes(picked).filter("parts > 1").select("label")), IDS_BROADCAST)
    small = picked.join(large, "label", "left_anti").repartition("label").sortWithinPartitions("label").mapInArrow(tidy(_join_groups), "id long, component long")
    if large.limit(1).count():
        links = components(cut(_large_groups(cut(picked.join(large, "label", "left_semi")))))
        small = small.unionByName(links.select("id", F.col("label").alias("component")))
    linked = cut(small.groupBy("id").agg(F.min("component").alias("component")).filter("id <> component"))

    copies = copies.select("id", "rep")
    if copies.groupBy("id").count().filter("count > 1").limit(1).count() or sets.select("id").join(left_out.select("id"), "id", "left_semi").limit(1).count():
        moved = components(linked.select(F.col("id").alias("a"), F.col("component").alias("b")).union(copies)).filter("id <> label").select("id", F.col("label").alias("component"))  # identifiers with several texts
    else:
        moved = copies.join(broadcast_upto(linked.select(F.col("id").alias("rep"), "component"), IDS_BROADCAST), "rep", "left").select("id", F.coalesce("component", "rep").alias("component")).union(linked)
    whole = narrow.select("id", "n").join(broadcast_upto(cut(moved), IDS_BROADCAST), "id", "left")
    return whole.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
