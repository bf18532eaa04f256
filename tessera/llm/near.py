"""Exact n-gram Jaccard join by count-vector R-trees (operator 6).

A document's set is its distinct word shingles, as 64-bit hashes.  Hashes fall into ``GROUPS`` groups;
the counts per group are a point, and the overlap of two sets is at most the sum of the coordinate
minima of their points.  An R-tree over points prunes with that bound (a node's upper corner bounds
all points below it), and surviving pairs are verified on the sets themselves.

One R-tree over a corpus neither fits a task nor prunes in this many dimensions, so trees are built
over *regions* that contain every pair which can link:

1. Two sets that link share one of the first ``n - ceil(0.75 n) + 1`` hashes of each, in any order
   that holds for all sets.  The order puts frequent hashes last (a list of bounded size, found by
   counting), so that common passages don't bring unrelated documents together.
2. Rows (hash, set) are dealt and sorted by hash; the sets that share a hash form a region led by
   the smallest.  Regions of one leader merge, so a group of copies is one region however many
   hashes it shares.
3. Leader-member pairs come first, each on its own: those that the bound on their points allows are
   verified, and their components labelled.  A region of one component is done, so a large group of
   near copies costs one verification a member.
4. Regions whose members other than the leader are of several components go through R-trees of points,
   in tiles of bounded size, which name the members that may link with another component.  Only those
   get their texts, and a second pass of the same trees verifies and emits the links that join two
   components.

The links found connect exactly what all links would, so components are those of the full join.  Equal
sets are one node throughout, so copies are never paired.  Nodes are 64-bit set fingerprints (two of
n distinct sets clash with probability n*n/2**65).

Rows: null and empty texts and texts without words have an empty set and link with nothing; a text
of fewer than five words has its whole sequence as one shingle; repeated rows and copies share a
component; null ids don't count for the smallest id; very long texts are whole sets.  Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, components, dealt_anew, give_back, mix64, row_slices, small_batches, stored, string_buffers, text_key
from tessera.llm.repeats import Prints

WORDS = 5
#: Links: PERCENT_OF * overlap >= PERCENT * union.
PERCENT, PERCENT_OF = 75, 100
#: Coordinates of the first and the second point of a set, a byte each.
GROUPS = (64, 1024)
FAN = 16
#: A hash is frequent from so many documents; the list keeps the most frequent (8 bytes each).
FREQUENT, FREQUENT_MOST = 16, 400_000
#: Sets that one R-tree holds at most twice.
TILE = 1000
#: Bytes of texts that a worker hashes at once, and whose shingles it counts at once.
SLICE, COUNTED = 1 << 20, 1 << 23
_U = np.uint64
_PLACES = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407], dtype=np.uint64)


def word_hashes(part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of lower-cased (A-Z) texts, and the first word's index of each text (one more at the end)."""
    low = np.where((part >= 65) & (part <= 90), part + 32, part).astype(np.uint8)
    gap = (low == 32) | ((low >= 9) & (low <= 13))
    edge = np.ones(len(low) + 1, dtype=bool)  # a word starts after a gap or at the start of a text
    edge[1:-1] = gap[:-1]
    edge[at] = True
    start = np.flatnonzero(edge[:-1] & ~gap)
    stop_edge = np.ones(len(low) + 1, dtype=bool)
    stop_edge[:-1] = gap
    stop_edge[at] = True
    stops = np.flatnonzero(stop_edge)
    end = stops[np.searchsorted(stops, start, side="right")] if len(start) else start
    h = mix64(Prints(low, 0).of(start, end) + (end - start).astype(np.uint64) * _PLACES[4])
    return h, np.searchsorted(start, at)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for a, b in row_slices(offsets, SLICE):
        h, first = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        rolled = np.zeros(max(0, len(h) - words + 1), dtype=np.uint64)
        for k in range(words):
            rolled += h[k : k + len(rolled)] * _PLACES[k % 5]
        rolled = mix64(rolled + _U(words))
        for i in range(b - a):
            n = first[i + 1] - first[i]
            if n >= words:
                yield np.unique(rolled[first[i] : first[i + 1] - words + 1])
            elif n:
                own = h[first[i] : first[i + 1]]
                yield mix64((own * _PLACES[:n]).sum(dtype=np.uint64, keepdims=True) + _U(n))
            else:
                yield np.zeros(0, dtype=np.uint64)


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // PERCENT_OF) + 1


def links(n_a: int, n_b: int, shared: int) -> bool:
    return PERCENT_OF * shared >= PERCENT * (n_a + n_b - shared)


def least_shared(n_a, n_b):
    """The overlap from which sets of these sizes link, rounded down."""
    return PERCENT * (n_a + n_b) // (PERCENT_OF + PERCENT)


def node_of(s: np.ndarray) -> int:
    """A signed 64-bit fingerprint of a set."""
    with np.errstate(over="ignore"):
        return int(mix64(np.array([mix64(s ^ _PLACES[0]).sum(dtype=np.uint64) + _U(len(s))], dtype=np.uint64)).view(np.int64)[0])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def point(s: np.ndarray, groups: int = GROUPS[0]) -> np.ndarray:
    return np.bincount((s & _U(groups - 1)).astype(np.int64), minlength=groups)


class CountTree:
    """A packed R-tree over count vectors: leaves of FAN points in order of size, levels of FAN nodes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        # sort-tile: by size, then within a slab by the group that varies most
        order = np.argsort(sizes, kind="stable")
        slab = FAN * FAN
        spread = points.var(axis=0).argmax() if len(points) else 0
        self.order = np.concatenate([o[np.argsort(points[o, spread], kind="stable")] for o in np.split(order, range(slab, len(order), slab))]) if len(order) else order
        self.levels = []
        top, low, high = points[self.order], sizes[self.order], sizes[self.order]
        while len(top) > 1:
            cut = np.arange(0, len(top), FAN)
            top, low, high = np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((top, low, high))

    def near(self, q: np.ndarray, n: int) -> np.ndarray:
        """Points whose summed minima with q reach the overlap that a link needs."""
        at = np.arange(len(self.levels[-1][0])) if self.levels else np.zeros(1, dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[k]
            ok = (PERCENT_OF * high[at] >= PERCENT * n) & (PERCENT * low[at] <= PERCENT_OF * n)
            ok &= np.minimum(top[at], q).sum(axis=1) >= least_shared(n, low[at])
            below = len(self.levels[k - 1][0]) if k else len(self.order)
            at = (at[ok][:, None] * FAN + np.arange(FAN)).ravel()
            at = at[at < below]
        rows = self.order[at]
        ok = np.minimum(self.points[rows], q).sum(axis=1) >= least_shared(n, self.sizes[rows])
        return rows[ok]


def _pack(sets: list[np.ndarray], groups: int) -> pa.Array:
    """Points as bytes; the largest value stands for any larger."""
    return pa.array([np.minimum(point(x, groups), 0xFF).astype(np.uint8).tobytes() for x in sets], pa.binary())


def _unpack(col: pa.Array) -> np.ndarray:
    x = np.frombuffer(b"".join(col.to_pylist()), dtype=np.uint8).reshape(len(col), -1).astype(np.int32)
    return np.where(x == 0xFF, 1 << 20, x)  # an upper bound all the same


def may_link(comps: list[int], sizes: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Which points of one region have a point of another component within the bound."""
    tree, comps = CountTree(points, sizes), np.array(comps)
    return np.array([bool((comps[tree.near(points[i], int(sizes[i]))] != comps[i]).any()) for i in range(len(comps))], dtype=bool)


def region_links(nodes: list[int], comps: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between different components of one region that join all that its links join."""
    root: dict[int, int] = {c: c for c in comps}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    left = len(root)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    points = np.array([point(s) for s in sets])
    tree = CountTree(points, sizes)
    out = []
    for i in range(len(nodes)):
        if left == 1:
            break
        for j in tree.near(points[i], int(sizes[i])).tolist():
            if j <= i or (a := find(comps[i])) == (b := find(comps[j])):
                continue
            if links(len(sets[i]), len(sets[j]), overlap(sets[i], sets[j])):
                root[a] = b
                left -= 1
                out.append((nodes[i], nodes[j]))
    return out


def _sets(batches):
    """A row (0, r1, r2, node, size) for each text, and (1, hash, texts) for hashes in two texts of a slice or more."""
    for batch in batches:
        data, offsets = string_buffers(batch.column(0))
        for a, b in row_slices(offsets, COUNTED):
            sets = list(shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
            h, n = np.unique(np.concatenate(sets), return_counts=True)
            h, n = h[n > 1].view(np.int64), n[n > 1]
            kind = np.repeat(np.array([0, 1], dtype=np.int8), [b - a, len(h)])
            none = pa.nulls(len(h), pa.int64())
            node = pa.chunked_array([pa.array([node_of(x) if len(x) else None for x in sets], pa.int64()), none]).combine_chunks()
            size = pa.array(np.r_[[len(x) for x in sets], n].astype(np.int64))
            r1 = pa.array(np.r_[np.asarray(batch.column(1))[a:b], h])
            r2 = pa.array(np.r_[np.asarray(batch.column(2))[a:b], np.zeros(len(h), dtype=np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(kind), r1, r2, node, size], names=["kind", "r1", "r2", "node", "size"])
    give_back()


def _prefixes(batches, frequent: np.ndarray):
    """(hash, node) for the prefix of each set, once a task for equal sets."""
    seen = set()
    for batch in small_batches(batches, 0):
        data, offsets = string_buffers(batch.column(0))
        hashes, nodes, lengths = [], [], []
        for s in shingles(data, offsets):
            if not len(s) or (node := node_of(s)) in seen:
                continue
            seen.add(node)
            p = prefix_length(len(s))
            if len(frequent):
                at = np.searchsorted(frequent, s)
                at[at == len(frequent)] = 0
                late = frequent[at] == s
                s = np.concatenate([s[~late], s[late]])
            hashes.append(s[:p])
            nodes.append(node)
            lengths.append(p)
        if nodes:
            h = np.concatenate(hashes).view(np.int64)
            n = np.repeat(np.array(nodes, dtype=np.int64), lengths)
            for at in range(0, len(h), 500_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[at : at + 500_000]), pa.array(n[at : at + 500_000])], names=["h", "node"])
    give_back()


def _regions(batches):
    """Rows sorted by (hash, node): (leader, node) for each node that is not the first of its hash."""
    last_hash = last_leader = None
    for batch in batches:
        h, node = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        if not len(h):
            continue
        new = np.r_[True, h[1:] != h[:-1]]
        leader = node[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))].copy()
        if h[0] == last_hash:
            end = int(np.searchsorted(h != last_hash, True)) if (h != last_hash).any() else len(h)
            leader[:end] = last_leader
        last_hash, last_leader = h[-1], leader[-1]
        pairs = np.stack([leader, node], axis=1)[leader != node]
        if len(pairs):
            pairs = np.unique(pairs, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["leader", "node"])
    give_back()


def _verified(batches):
    """Pairs (a, b) whose texts link."""
    for batch in small_batches(batches, 2):
        a, b = (list(shingles(*string_buffers(batch.column(i)))) for i in (2, 3))
        ok = [links(len(x), len(y), overlap(x, y)) for x, y in zip(a, b)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
    give_back()


def _within_bound(batches):
    """Pairs (a, b) whose sizes and points allow a link."""
    for batch in batches:
        a, b, na, nb, pa_, pb = (batch.column(i) for i in range(6))
        na, nb = np.asarray(na), np.asarray(nb)
        ok = PERCENT_OF * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)
        rows = np.flatnonzero(ok)
        for at in range(0, len(rows), 500):
            part = rows[at : at + 500]
            take = pa.array(part)
            most = np.minimum(_unpack(pa_.take(take)), _unpack(pb.take(take))).sum(axis=1)
            ok[part] = most >= least_shared(na[part], nb[part])
        yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(ok))
    give_back()


def _by_tile(batches, finish):
    """finish(rows of a tile) for rows sorted by tile, each node once."""
    held: list[pa.RecordBatch] = []

    def done():
        rows = pa.Table.from_batches(held).combine_chunks()
        first = {n: i for i, n in reversed(list(enumerate(rows.column(1).to_pylist())))}
        return finish(rows.take(pa.array(sorted(first.values()))).combine_chunks())

    current = None
    for batch in batches:
        tile = np.asarray(batch.column(0))
        cuts = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist(), len(tile)] if len(tile) else []
        for at, end in zip(cuts, cuts[1:]):
            if tile[at] != current and held:
                yield from done()
                held = []
            current = tile[at]
            held.append(batch.slice(at, end - at))
    if held:
        yield from done()
        held = []
    give_back()


def _open_rows(rows: pa.Table):
    """(tile, node, comp) of the members of a tile that may link with another component."""
    points = np.concatenate([_unpack(c) for c in rows.column(4).chunks])
    ok = may_link(rows.column(2).to_pylist(), np.asarray(rows.column(3)), points)
    if ok.any():
        yield from rows.select([0, 1, 2]).filter(pa.array(ok)).to_batches()


def _tile_links(rows: pa.Table):
    sets = [s for chunk in rows.column(3).chunks for s in shingles(*string_buffers(chunk))]
    found = region_links(rows.column(1).to_pylist(), rows.column(2).to_pylist(), sets)
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def frequent_hashes(counts: DataFrame) -> np.ndarray:
    """The sorted hashes of the most frequent shingles of (h, n) rows, FREQUENT_MOST at most."""
    counted = counts.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    most = counted.orderBy(F.col("n").desc(), "h").limit(FREQUENT_MOST).select("h").toArrow()
    return np.sort(np.asarray(most.column(0)).view(np.uint64)) if len(most) else np.zeros(0, dtype=np.uint64)


def open_members(regions: DataFrame, labels: DataFrame) -> DataFrame:
    """(leader, node, comp, parts) of the regions whose members, without the leader, are of several components.

    Every pair with a leader was compared before, so only pairs of two other members are left.
    """
    whole = regions.join(labels, "node", "left").select("leader", "node", F.coalesce("component", "node").alias("comp"))
    open_ = whole.groupBy("leader").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    return whole.join(dealt_anew(open_.select("leader", F.ceil(F.col("n") / TILE).cast("int").alias("parts")), "leader"), "leader")


def near_links(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts: r1, r2, node, size; labels: node, component) with a label for each linked node."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), *text_key(F.col(text_col)))
    first = stored(texts.select("text", "r1", "r2").mapInArrow(_sets, "kind tinyint, r1 bigint, r2 bigint, node bigint, size bigint"))
    sets = checkpointed(first.where("kind = 0").drop("kind").distinct())
    frequent = frequent_hashes(first.where("kind = 1").select(F.col("r1").alias("h"), F.col("size").alias("n")))
    rows = texts.select("text").mapInArrow(lambda it: _prefixes(it, frequent), "h bigint, node bigint")
    regions = rows.repartition("h").sortWithinPartitions("h", "node").mapInArrow(_regions, "leader bigint, node bigint")
    regions = checkpointed(regions.distinct())

    # one text for each node of a region
    members = regions.select("node").unionAll(regions.select(F.col("leader").alias("node"))).distinct()
    chosen = sets.groupBy("node").agg(F.min(F.struct("r1", "r2")).alias("x")).join(members, "node", "left_semi").select("node", "x.*")
    held = stored(texts.join(chosen, ["r1", "r2"]).select("r1", "r2", "text", "node").mapInArrow(_once, "node bigint, size bigint, p0 binary, p1 binary, text string"))

    def both(pairs: DataFrame, *columns: str) -> DataFrame:
        for c in ("a", "b"):
            pairs = pairs.join(held.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in columns]), c)
        return pairs.select("a", "b", *[f"{x}_{c}" for x in columns for c in ("a", "b")])

    pairs = both(regions.select(F.col("leader").alias("a"), F.col("node").alias("b")), "size")
    pairs = pairs.where(PERCENT_OF * F.least("size_a", "size_b") >= PERCENT * F.greatest("size_a", "size_b")).select("a", "b")
    for p in ("p0", "p1"):
        pairs = checkpointed(both(pairs, "size", p).mapInArrow(_within_bound, "a bigint, b bigint"))
    stars = checkpointed(both(pairs, "text").mapInArrow(_verified, "a bigint, b bigint"))
    labels = checkpointed(components(stars))

    rows = open_members(regions, labels).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tile = F.xxhash64("leader", F.least("own", "other"), F.greatest("own", "other"))
    rows = rows.select(tile.alias("tile"), "node", "comp")

    # a number of partitions, because the time that a tile takes is not that of its bytes, by which Spark would gather them
    dealt = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def tiles(*columns: str) -> DataFrame:
        return rows.join(held.select("node", *columns), "node").select("tile", "node", "comp", *columns).repartition(dealt, "tile").sortWithinPartitions("tile")

    for p in ("p0", "p1"):
        rows = checkpointed(tiles("size", p).mapInArrow(lambda it: _by_tile(it, _open_rows), "tile bigint, node bigint, comp bigint"))
    rows = tiles("text")
    more = checkpointed(rows.mapInArrow(lambda it: _by_tile(it, _tile_links), "a bigint, b bigint"))
    if not more.isEmpty():
        labels = checkpointed(components(stars.unionAll(more)))
    return sets, labels


def _once(batches):
    """(node, size, p0, p1, text) of the first row of each node that a task meets (copies of a text have equal rows)."""
    seen = set()
    for batch in small_batches(batches, 2):
        column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
        rows = pa.array([i for i, n in enumerate(column("node").to_pylist()) if not (n in seen or seen.add(n))], pa.int64())
        texts = column("text").take(rows)
        sets = list(shingles(*string_buffers(texts)))
        points = [_pack(sets, g) for g in GROUPS]
        yield pa.RecordBatch.from_arrays([column("node").take(rows), pa.array([len(x) for x in sets], pa.int64()), *points, texts], names=["node", "size", "p0", "p1", "text"])
    give_back()


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: doc_id, n_shingles, component_id (the smallest id reachable by links)."""
    sets, labels = near_links(docs, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), *text_key(F.col(text_col)))
    named = sets.join(labels, "node", "left").select("r1", "r2", "size", F.coalesce("component", "node").alias("label"))
    rows = checkpointed(rows.join(named, ["r1", "r2"]).select("doc_id", "size", "label"))
    least = rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    return rows.join(dealt_anew(least, "label"), "label", "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
