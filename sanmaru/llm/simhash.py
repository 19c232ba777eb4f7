"""SimHash near-dedup: fingerprints of word shingles, linked through BK-trees over shards.

Distinct fingerprints are dealt to shards by pigeonhole: of more bands of bits than bits may differ, two linked ones share
a band, so both stand in the shard of that band's value. (With very many fingerprints, two or three bands at once name a
shard, which keeps shards small.) A task builds the BK-trees of its shards, where children are keyed by their integer
Hamming distance to the parent, and asks them for each fingerprint, following only edges within the radius. Shards of over
``SHARD`` fingerprints are split into several trees; those are broadcast (beyond a checked size: joined by a shuffle) to
the fingerprints of the other trees of that shard.

Fingerprints need no link to each partner but only one to what it hangs together with. Links to ancestors, which building
a tree shows anyway, group a tree first; then a search leaves out subtrees that all belong to the asking group already.
So a dense group costs little more than its size, and a tree gives fewer links than it has nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sanmaru.llm.common import broadcast_bytes, broadcast_upto, cut, tidy
from sanmaru.llm.components import components
from sanmaru.llm.hashing import slices

WORDS, RADIUS, SEED = 4, 4, 42
#: Fingerprints of a tree at most, about.
SHARD = 4096
#: Fingerprints from which on two, three, ... bands name a shard.
MORE_BANDS = (1 << 24, 1 << 30)
#: Pairs of a fingerprint and a node that a level of a search expands at once, and fingerprints that ask at once.
FRONTIER, ASKING = 1 << 16, 1024
#: Identifiers that may be broadcast.
IDS_BROADCAST = 1_000_000
#: Bytes of a text that are hashed at once (a longer word stands alone), and hashes whose bits are counted at once.
CHUNK, COUNTED = 1 << 20, 1 << 14


def shingles(text: str) -> Iterator[list[bytes]]:
    """Shingles of a text in lists of bounded size; A-Z count as a-z. Fewer words than a shingle make one of them all."""
    whole, lo, kept, any_yet = text.encode(), 0, [], False
    while lo < len(whole):
        hi = min(len(whole), lo + CHUNK)
        while hi < len(whole) and not (whole[hi] == 32 or 9 <= whole[hi] <= 13):
            hi += 1
        words = kept + whole[lo:hi].lower().split()
        if len(words) >= WORDS:
            any_yet = True
            joined, at = b" ".join(words), np.cumsum([0, *(len(w) + 1 for w in words)])
            yield list(map(joined.__getitem__, map(slice, at[: -WORDS].tolist(), (at[WORDS:] - 1).tolist())))
        kept, lo = words[-(WORDS - 1) :], hi
    if kept and not any_yet:
        yield [b" ".join(kept)]


def fingerprint(text: str | None) -> int:
    """The signed 64-bit SimHash of a text; 0 without words."""
    from xxhash import xxh64_intdigest

    ones, n = np.zeros(64, np.int64), 0
    for part in shingles(text or ""):
        hashes = np.fromiter(map(xxh64_intdigest, part, repeat(SEED)), np.uint64, len(part))
        for lo in range(0, len(hashes), COUNTED):
            bits = np.unpackbits(hashes[lo : lo + COUNTED].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, column=1):
        found = pa.array([fingerprint(t) for t in batch.column(1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["id", "fp"])


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int64)


def _joined(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The least label of all that pairs ``a, b`` connect, for each of ``0..n-1``; ``label`` names what is connected before."""
    label = np.arange(n) if label is None else label.copy()
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        to = np.arange(n)
        np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
        while (further := to[to] != to).any():
            to[further] = to[to[further]]
        label = to[label]


class Forest:
    """BK-trees of several shards. Nodes are numbered by level; ``node`` says which item a node holds, ``root`` the tree's first node."""

    def __init__(self, shard: np.ndarray, items: np.ndarray):
        n = len(items)
        self.items, self.at = items, np.full(n, -1)  # at: the node of each item
        _, first, tree = np.unique(shard, return_index=True, return_inverse=True)
        self.parent, self.edge, self.node = [np.full(len(first), -1)], [np.zeros(len(first), np.int64)], [first]
        self.at[first] = np.arange(len(first))
        self.root, self.levels = tree, [0, len(first)]
        left = np.setdiff1d(np.arange(n), first)
        under, links = tree[left], []  # the node that an item has come to
        holder = first  # item of each node so far
        while len(left):
            d = _distance(items[left], items[holder[under]])
            near = d <= RADIUS
            links.append(np.stack([left[near], holder[under[near]]]))
            key = under * 65 + d
            keys, new, own = np.unique(key, return_index=True, return_inverse=True)
            start = len(holder)
            self.parent.append(keys // 65)
            self.edge.append(keys % 65)
            self.at[left[new]] = start + np.arange(len(keys))
            holder = np.concatenate([holder, left[new]])
            self.levels.append(len(holder))
            rest = np.ones(len(left), bool)
            rest[new] = False
            left, under = left[rest], (start + own)[rest]
        self.parent, self.edge, self.node = np.concatenate(self.parent), np.concatenate(self.edge), holder
        self.fp = items[holder]
        self.children = np.argsort(self.parent * 65 + self.edge, kind="stable")  # roots first
        self.keys = (self.parent * 65 + self.edge)[self.children]
        found = np.concatenate([*links, np.zeros((2, 0), np.int64)], axis=1)
        self.label = _joined(n, found[0], found[1])  # of items: the least item that links among ancestors reach
        self.summarise()

    def summarise(self) -> None:
        """The least and greatest label of each subtree."""
        self.least, self.most = self.label[self.node].copy(), self.label[self.node].copy()
        for lo, hi in reversed(list(zip(self.levels[1:-1], self.levels[2:], strict=True))):
            np.minimum.at(self.least, self.parent[lo:hi], self.least[lo:hi])
            np.maximum.at(self.most, self.parent[lo:hi], self.most[lo:hi])

    def hits(self, query: np.ndarray, root: np.ndarray, label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of queries and of items within the radius, in turns, from each query's ``root``. Subtrees that belong to
        a query's ``label`` as a whole are left out, as are items of that label."""
        for lo in range(0, len(query), ASKING):
            stack = [(np.arange(lo, min(lo + ASKING, len(query))), root[lo : lo + ASKING])]
            while stack:
                q, node = stack.pop()
                if len(q) > FRONTIER:
                    stack += [(q[FRONTIER:], node[FRONTIER:])]
                    q, node = q[:FRONTIER], node[:FRONTIER]
                if label is not None:
                    open_ = (self.least[node] != label[q]) | (self.most[node] != label[q])
                    q, node = q[open_], node[open_]
                d = _distance(query[q], self.fp[node])
                near = d <= RADIUS
                if near.any():
                    item = self.node[node[near]]
                    other = q[near]
                    if label is not None:
                        differs = self.label[item] != label[other]
                        other, item = other[differs], item[differs]
                    if len(other):
                        yield other, item
                first = np.searchsorted(self.keys, node * 65 + np.maximum(d - RADIUS, 0))
                count = np.searchsorted(self.keys, node * 65 + np.minimum(d + RADIUS, 64), side="right") - first
                if total := int(count.sum()):
                    nth = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
                    stack.append((np.repeat(q, count), self.children[np.repeat(first, count) + nth]))

    def join(self) -> None:
        """Complete ``label``: ask for each item that isn't alone in a tree."""
        sizes = np.bincount(self.root)
        asked = np.flatnonzero(sizes[self.root] > 1)
        for lo in range(0, len(asked), ASKING):
            part = asked[lo : lo + ASKING]
            found = [np.stack([part[q], item]) for q, item in self.hits(self.items[part], self.root[part], self.label[part])]
            if found:
                a, b = np.concatenate(found, axis=1)
                self.label = _joined(len(self.items), a, b, self.label)
                self.summarise()


def _links_in_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows ``shard, fp, rep`` sorted by shard: links ``a, b`` that connect what each shard connects.

    Rows of the shards that are begun and of at most a batch are held; a shard holds about ``SHARD`` rows.
    """
    held = np.zeros((3, 0), np.int64)

    def close(rows: np.ndarray) -> pa.RecordBatch:
        forest = Forest(rows[0], rows[1])
        forest.join()
        joined = np.flatnonzero(forest.label != np.arange(rows.shape[1]))
        return pa.RecordBatch.from_arrays([pa.array(rows[2][forest.label[joined]]), pa.array(rows[2][joined])], names=["a", "b"])

    for batch in batches:
        rows = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
        if not rows.shape[1]:
            continue
        begun = int(np.searchsorted(rows[0], rows[0, -1]))
        if begun:
            yield close(rows[:, :begun])
        held = rows[:, begun:]
    if held.shape[1]:
        yield close(held)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows ``shard, tree, fps, reps``: each with its fingerprints grouped by what links them inside, in ``groups`` (numbers of rows)."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            forest = Forest(np.zeros(len(row.column(2)[0]), np.int64), row.column(2).flatten().to_numpy(zero_copy_only=False))
            forest.join()
            groups = pa.ListArray.from_arrays(pa.array([0, len(forest.label)], pa.int32()), pa.array(forest.label))
            yield pa.RecordBatch.from_arrays([*row.columns, groups], names=["shard", "tree", "fps", "reps", "groups"])


def _links_across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows ``fps, reps, groups, fps, reps, groups``: links between the groups of both sides, one for each pair of them."""
    for batch in batches:
        for i in range(batch.num_rows):
            fps, reps, groups, asked, asked_reps, asked_groups = (batch.column(c).slice(i, 1).flatten().to_numpy(zero_copy_only=False) for c in range(6))
            forest = Forest(np.zeros(len(fps), np.int64), fps)
            forest.label = groups
            forest.summarise()
            n = len(fps)
            label, open_ = np.concatenate([groups, n + asked_groups]), np.arange(len(asked))
            for part in np.array_split(open_, -(-len(open_) // ASKING)):
                own = label[n + part]  # queries that a tree's group has taken in leave it out
                found = [np.stack([item, n + part[q]]) for q, item in forest.hits(asked[part], np.zeros(len(part), np.int64), own)]
                if found:
                    a, b = np.concatenate(found, axis=1)
                    label = _joined(len(label), a, b, label)
                    forest.label = label[:n]
                    forest.summarise()
            number = np.concatenate([reps, asked_reps])
            joined = np.flatnonzero(label[n:] < n)
            first = np.unique(asked_groups[joined], return_index=True)[1]
            yield pa.RecordBatch.from_arrays([pa.array(number[label[n + joined[first]]]), pa.array(asked_reps[joined[first]])], names=["a", "b"])
            merged = np.flatnonzero(label[:n] != groups)  # groups of the tree that the other side connects
            first = np.unique(groups[merged], return_index=True)[1]
            yield pa.RecordBatch.from_arrays([pa.array(number[label[merged[first]]]), pa.array(reps[merged[first]])], names=["a", "b"])


def band_keys(fp: Column, at_once: int = 1) -> Column:
    """Numbers of the shards of a fingerprint: of ``RADIUS + at_once`` bands, each choice of ``at_once`` with its bits."""
    bands = RADIUS + at_once
    edges = [64 * i // bands for i in range(bands + 1)]
    bits = [F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1)) for i in range(bands)]
    return F.array(*(F.xxhash64(F.lit(n), *(bits[i] for i in chosen)) for n, chosen in enumerate(combinations(range(bands), at_once))))


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links ``a, b`` that connect all of ``prints(fp, rep)`` (distinct fingerprints, each with a number) within the radius."""
    total = prints.count()
    at_once = 1 + sum(total > n for n in MORE_BANDS)
    dealt = prints.select(F.explode(band_keys(F.col("fp"), at_once)).alias("shard"), "fp", "rep")
    sizes = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(f"n > {SHARD}")
    large = broadcast_upto(cut(sizes.select("shard", F.ceil(F.col("n") / SHARD).alias("trees"))), IDS_BROADCAST)
    small = dealt.join(large, "shard", "left_anti").repartition("shard").sortWithinPartitions("shard")
    links = small.select("shard", "fp", "rep").mapInArrow(tidy(_links_in_shards), "a long, b long")
    if not large.limit(1).count():
        return links
    split = dealt.join(large, "shard").withColumn("tree", F.pmod(F.xxhash64("fp", F.lit("tree")), F.col("trees")))
    packed = split.groupBy("shard", "tree").agg(F.collect_list(F.struct("fp", "rep")).alias("all"))  # about SHARD rows each
    columns = "shard long, tree long, fps array<long>, reps array<long>, groups array<long>"
    trees = cut(packed.select("shard", "tree", F.col("all.fp").alias("fps"), F.col("all.rep").alias("reps")).mapInArrow(tidy(_trees), columns))
    inside = trees.select(F.posexplode("groups").alias("at", "group"), "reps").filter("at <> group").select(F.get("reps", F.col("group").cast("int")).alias("a"), F.get("reps", "at").alias("b"))
    asked = trees.select("shard", *(F.col(c).alias(f"asked_{c}") for c in ("tree", "fps", "reps", "groups")))
    sent = broadcast_bytes(trees, "fps", "reps", "groups")
    asked = asked.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard", "asked_tree")  # searching takes longer than the size of rows tells
    pairs = asked.join(trees if sent is None else sent, "shard").filter("tree < asked_tree")
    across = pairs.select("fps", "reps", "groups", "asked_fps", "asked_reps", "asked_groups").mapInArrow(tidy(_links_across), "a long, b long")
    return links.union(inside).union(across)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, fingerprint, component_id``.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Null, empty and blank texts have the fingerprint 0,
    which links like any other. Fingerprints link at ``RADIUS`` or fewer differing bits. Rows that share an identifier are
    one node of the link graph; rows with a null identifier link with nothing and have a null component. Repeated rows
    are returned as often as they occur; an empty table gives no rows; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = cut(texts.mapInArrow(tidy(_fingerprints), "id long, fp long"))
    named = found.filter("id is not null")
    prints = cut(named.groupBy("fp").agg(F.min("id").alias("rep"), F.max("id").alias("last")))
    links = fingerprint_links(prints.select("fp", "rep"))
    several = cut(named.groupBy("id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).filter("x <> y").select("id"))
    if several.limit(1).count():  # identifiers with several fingerprints connect these
        own = named.join(broadcast_upto(several, IDS_BROADCAST), "id").distinct().join(prints.select("fp", "rep"), "fp")
        links = links.union(own.select(F.col("rep").alias("a"), F.col("id").alias("b")))
    moved = components(links.distinct()).filter("id <> label").select(F.col("id").alias("rep"), "label")
    # fingerprints whose rows aren't all alone: only these need a join
    shared = prints.join(broadcast_upto(cut(moved), IDS_BROADCAST), "rep", "left").filter("rep <> last or label is not null")
    shared = shared.select("fp", F.coalesce("label", "rep").alias("component"))
    whole = found.join(broadcast_upto(cut(shared), IDS_BROADCAST), "fp", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return whole.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))
