"""Operator 10, n-gram Jaccard join: a count-vector R-tree.

A text is the set of its distinct 3-word shingles; texts of one set are one class, told
apart by a 128-bit digest, with its smallest document for representative. Shingles are
hashed into blocks and, in a block, into LEAF_GROUPS groups; the group counts of a block are a
point (with few groups, long texts would meet by chance in blocks of one or two shingles). The tree's first level is the set's size, its second the block, its leaves the
points. Sets a and b that link differ in at most T = (|a| + |b|) // 19 shingles, so of
T + 1 + s blocks at least 1 + s points are equal: the query box of such a block is a
single leaf, found by an equi-join on the leaf's key, exactly and without a cap. A set has
s leaves to spare and leaves out the s that most sets enter, so leaves that hold next to
nothing, or a common passage alone, join nobody. As all sets rank leaves alike (by sets
that enter, then key), the least shared of a link's 1 + s equal leaves is kept by both.
Counts go to leaves and back by blocks of sets, a leaf counted once a block.

This first level is no box but one key, as boxes over points of unrelated texts meet every
query and would prune nothing; boxes come where points lie close, within a cluster.

Of sets that meet in a leaf, pairs pass whose overlap, bounded by the summed minima of the
count vectors of the whole sets, can be enough. In a leaf of more than CROWD sets all pass
unseen: they are joined by a star to their least (first within a block of sets, then among
blocks, so a leaf that a third of all rows share gets a row a block). Pairs that touch are
a candidate cluster. Within clusters, in blocks of sets and pairs of blocks, BLOCK by BLOCK sets, finer
count vectors are indexed: sets of like size make nodes of NODE points under a box of the
largest counts; a search descends from boxes whose summed minima can be enough to points,
and pairs of points that pass are verified on whole sets. Only a spanning forest of the
links found leaves a task; links of different clusters cannot exist.

Classes are numbered by a 64-bit hash of their digest, not by doc_id; a class that many
rows share is counted and named by itself, so no task gets all its rows.

Defined results: nulls and texts without words have an empty set and link with nothing;
texts of one or two words have their whole sequence as one shingle; repeated rows are
texts of one class and give a row each; rows that share a doc_id with different texts are
documents of their own in links, under one id; a row without doc_id takes part, and a
group of such rows alone has a null component_id; an empty table gives none; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, LOWER, Words, blocks, bounded_batches, documents, dropped, grams, mix, released, stored, written
from .components import components

#: Groups that shingles are counted by in the point of a whole set, where sets meet.
GROUPS = 64
#: Groups in a block's point: so many that sets meet in a leaf by what they share and hardly by chance.
LEAF_GROUPS = 1 << 31
#: Leaves that a block of sets holds.
LEAVES = 100_000
#: Sets in a leaf that are compared pair by pair.
CROWD = 128
#: Sets of a cluster that are compared at once.
BLOCK = 256
#: Sets that a block of a cluster holds on average, where they are small: a set is sent once a block.
BLOCK_SETS = 8 * BLOCK
#: Pairs that a task holds before it settles which sets they tie.
PAIRS = 200_000
#: Shingles that a block of a cluster holds on average, where its sets are large.
BLOCK_SHINGLES = 1 << 20
BOUND_GROUPS = 256
#: Bytes of sets that a task sends on at once.
SENT_BYTES = 1 << 20
#: Bits by which rows are marked before a join.
BITS = 1 << 26
#: Points under one box.
NODE = 16
#: A class is named by a broadcast where it holds more than this share of all rows; so there are no more than so many.
SHARE = 1000
#: Bytes of a leaf key, as it travels; two leaves taken for one only meet in vain.
KEY = 6


class Sizes:
    """Classes of set sizes for a similarity of percent / 100, and the blocks of each."""

    def __init__(self, percent: int, most: int):
        self.percent, self.low = percent, [1]
        while self.low[-1] <= most:
            self.low.append(self.low[-1] * 100 // percent + 1)
        self.high = [x - 1 for x in self.low[1:]]

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.low, n, "right")) - 1

    def differ(self, k: int) -> int:
        """The most shingles by which a link's sets differ whose smaller one is in class k."""
        a = self.high[k]
        b = a * 100 // self.percent
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def blocks(self, k: int) -> tuple[int, int]:
        """Blocks of class k, and how many of them may be left out."""
        t = self.differ(k)
        spare = 1 + t // 3
        return t + 1 + spare, spare

    def entered(self, n: int) -> list[int]:
        """Classes that a set of n shingles enters: its own, and the one below if its larger partners reach n."""
        if not n:
            return []
        k = self.of(n)
        out = [k] if self.differ(k) else []
        if k and self.differ(k - 1) and n * self.percent <= self.high[k - 1] * 100:
            out.append(k - 1)
        return out


def shingles(text: pa.Array, n: int, separators: np.ndarray = BLANKS) -> list[np.ndarray]:
    """The sorted distinct n-word shingle hashes of each text; a shorter text's words are one shingle."""
    words = Words(text, separators, LOWER)
    one = words.hashes(10)
    whole = grams(one, n)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(whole[a : b - n + 1]))
        elif b > a:
            out.append(mix(grams(one[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def leaves(own: np.ndarray, sizes: Sizes) -> np.ndarray:
    """Keys of a set's leaves: all blocks of each class that it enters."""
    out = []
    for k in sizes.entered(len(own)):
        count, _ = sizes.blocks(k)
        spread = mix(own ^ np.uint64(0xA24BAED4963EE407 + k))
        block = (spread >> np.uint64(32)).astype(np.int64) % count
        point = mix(spread & np.uint64(LEAF_GROUPS - 1))
        order = np.argsort(block, kind="stable")
        total = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(point[order], out=total[1:])
        size = np.bincount(block, minlength=count)
        end = np.cumsum(size)
        key = total[end] - total[end - size]  # a linear hash of the block's group counts
        key = mix(mix(key + size.astype(np.uint64)) + np.arange(count, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(k + 1 << 40))
        out.append(key)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def packed_keys(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY]).tobytes()


def keys_of(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY, 8), np.uint8)
    out[:, :KEY] = np.frombuffer(data, np.uint8).reshape(-1, KEY)
    return out.view("<u8").ravel()


def point(own: np.ndarray) -> bytes:
    """Counts of a whole set's groups, one byte each; cut at 255, which only brings points closer."""
    return np.minimum(np.bincount((own & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS), 255).astype(np.uint8).tobytes()


def row_and_text(docs: DataFrame) -> DataFrame:
    """row (doc_id; for rows without one a hash of the text), doc_id, text_hash, text."""
    ids, text = docs["doc_id"].cast("long"), docs["text"].cast("string")
    return docs.select(F.coalesce(ids, F.xxhash64(text)).alias("row"), ids.alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def digest_of(own: np.ndarray) -> bytes | None:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def signed(docs: DataFrame, n: int, percent: int, separators: np.ndarray, indexed: bool) -> DataFrame:
    """Of each row the size and the digest of its set (null if empty); for the index leaf keys and a point instead of what names the row."""
    schema = "row long, " + ("" if indexed else "doc_id long, text_hash long, ") + "n_shingles long, digest binary" + ", leaves binary, point binary" * indexed
    names = [c.split()[0] for c in schema.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            sets = shingles(block.column("text"), n, separators)
            columns = [block.column(c) for c in names[: names.index("n_shingles")]]
            columns += [pa.array([len(s) for s in sets], pa.int64()), pa.array([digest_of(s) for s in sets], pa.binary())]
            if indexed:
                sizes = Sizes(percent, max(map(len, sets)) + 1)
                columns += [pa.array([packed_keys(leaves(s, sizes)) for s in sets], pa.binary()), pa.array([point(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return row_and_text(docs).mapInArrow(task, schema)


def _stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, the least id of each key, and which entries are that one."""
    order = np.lexsort((ids, keys))
    new = np.ones(len(order), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order, ids[order][lead], new


def _edge_batch(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = a != b
    pairs = np.unique(np.stack([a[keep], b[keep]], 1), axis=0) if keep.any() else np.empty((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def dealt(keys: np.ndarray, parts: int, *columns: np.ndarray) -> Iterator[tuple]:
    """Columns cut by the part that the key beside them is dealt to."""
    part = part_of(keys, parts)
    order = np.argsort(part, kind="stable")
    for g in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []:
        yield int(part[g[0]]), *(c[g].tobytes() for c in columns)


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Each part, in order, and its rows."""
    part, held = None, []
    for batch in batches:
        for own, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != part:
                if held:
                    yield part, held
                part, held = own, []
            held.append(row)
    if held:
        yield part, held


def leaf_blocks(classes: DataFrame) -> tuple[DataFrame, str]:
    """Sets and their leaf keys in blocks of about LEAVES leaves: block, ids, sizes, leaves, points; and where they are stored."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, points = batch.column("leaves").to_pylist(), batch.column("point").to_pylist()
            ids, sizes = np.asarray(batch.column("node")), np.asarray(batch.column("n_shingles"))
            ends = np.cumsum([len(x) // KEY for x in data])
            at = 0
            while at < len(data):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LEAVES, "right")))
                row = (uuid.uuid4().int >> 65, ids[at:to].astype("<i8").tobytes(), sizes[at:to].astype("<i8").tobytes(), b"".join(data[at:to]), b"".join(points[at:to]))
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[1:])], names=["block", "ids", "sizes", "leaves", "points"])
                at = to

    return stored(classes.sparkSession, classes.mapInArrow(task, "block long, ids binary, sizes binary, leaves binary, points binary"), "leaf-blocks")


def shared_leaves(held: DataFrame, parts: int) -> DataFrame:
    """For each block of sets and part: the leaves that more than one set enters, and how many do (block, part, leaves, counts).

    Leaves are told apart by part and 32 bits more here; where two are taken for one, both rank by their sum.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("leaves").to_pylist(), strict=True):
                keys, counts = np.unique(keys_of(data), return_counts=True)
                rows = [(part, block, low, zlib.compress(n, 1)) for part, low, n in dealt(keys, parts, keys.astype("<u4"), counts.astype("<u4"))]
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["part", "block", "leaves", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in by_part(batches):
            _, at = np.unique(np.frombuffer(b"".join(r[1] for r in rows), "<u4"), return_inverse=True)
            total = np.bincount(at, np.frombuffer(b"".join(zlib.decompress(r[2]) for r in rows), "<u4")).astype("<i8")[at]
            first, out = 0, []
            for block, data, _ in rows:
                own = total[first : first + len(data) // 4]
                first += len(own)
                if (own > 1).any():
                    out.append((block, part, np.frombuffer(data, "<u4")[own > 1].tobytes(), own[own > 1].tobytes()))
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["block", "part", "leaves", "counts"])

    packed = held.select("block", "leaves").mapInArrow(count, "part int, block long, leaves binary, counts binary")
    spread = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed.repartition(spread, "part").sortWithinPartitions("part").mapInArrow(add, "block long, part int, leaves binary, counts binary")


def entered(held: DataFrame, percent: int) -> DataFrame:
    """node, n_shingles, point, and the shared leaves that a set enters, without those it leaves out; crowded ones apart."""
    parts = 4 * int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = shared_leaves(held, parts).groupBy("block").agg(F.collect_list(F.struct("part", F.col("leaves").alias("shared"), "counts")).alias("told"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, size, own, points, told in zip(*(batch.column(c).to_pylist() for c in ("ids", "sizes", "leaves", "points", "told")), strict=True):
                ids, size, own = np.frombuffer(ids, "<i8"), np.frombuffer(size, "<i8"), keys_of(own)
                shared = np.concatenate([np.frombuffer(t["shared"], "<u4").astype(np.int64) | t["part"] << 32 for t in told])
                counts = np.frombuffer(b"".join(t["counts"] for t in told), "<i8")
                order = np.argsort(shared)
                shared, counts = shared[order], counts[order]
                short = own.astype(np.uint32).astype(np.int64) | part_of(own, parts) << 32
                at = np.minimum(np.searchsorted(shared, short), len(shared) - 1)
                many = np.where(shared[at] == short, counts[at], 1)
                sizes = Sizes(percent, int(size.max()) + 1)
                runs = {n: [sizes.blocks(k) for k in sizes.entered(n)] for n in set(size.tolist())}
                runs = [(doc, *run) for doc, n in enumerate(size.tolist()) for run in runs[n]]
                doc, length, spare = np.array(runs).T
                run = np.repeat(np.arange(len(length)), length)
                order = np.lexsort((own, many, run))  # runs stay in place, the most shared leaves last in each
                keep = np.arange(len(own)) < (np.cumsum(length) - spare)[run]
                order = order[keep & (many[order] > 1)]
                few = many[order] <= CROWD
                columns = []
                for left in (order[few], order[~few]):
                    cuts = np.searchsorted(doc[run[left]], np.arange(len(ids) + 1)).tolist()
                    columns.append(pa.array([packed_keys(own[left[i:j]]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()))
                points = pa.array([points[k : k + GROUPS] for k in range(0, len(points), GROUPS)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(size), points, *columns], names=["node", "n_shingles", "point", "leaves", "crowded"])

    return held.join(told, "block").mapInArrow(task, "node long, n_shingles long, point binary, leaves binary, crowded binary")


def close(keys: np.ndarray, ids: np.ndarray, size: np.ndarray, points: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars over the sets that meet under one key in pairs whose summed minima allow a link."""
    order = np.lexsort((ids, keys))
    keys, size, points = keys[order], size[order], points[order]
    node, at = np.unique(ids[order], return_inverse=True)
    label = np.arange(len(node))
    left, right, held = [], [], 0

    def settled(label: np.ndarray) -> np.ndarray:
        """Labels after the pairs at hand, which need not be kept then."""
        x, y = (np.concatenate(side) for side in (left, right))
        x, y = label[x], label[y]
        own = np.arange(len(node))
        while True:
            low = np.minimum(own[x], own[y])
            if np.array_equal(low, own[x]) and np.array_equal(low, own[y]):
                return own[label]
            np.minimum.at(own, x, low)
            np.minimum.at(own, y, low)
            np.minimum(own, own[own], out=own)

    for step in range(1, len(keys)):
        first = np.flatnonzero(keys[step:] == keys[:-step])
        if not len(first):
            break
        for few in np.array_split(first, 1 + len(first) // 20_000):
            few = few[label[at[few]] != label[at[few + step]]]  # others are together already
            total = size[few] + size[few + step]
            bound = (total - np.abs(points[few].astype(np.int16) - points[few + step]).sum(1)) // 2
            few = few[(100 + percent) * bound >= percent * total]
            if len(few):
                left.append(at[few])
                right.append(at[few + step])
                held += len(few)
            if held > PAIRS:
                label = settled(label)
                left, right, held = [], [], 0
    if held:
        label = settled(label)
    return _edge_batch(node, node[label])


def candidates(sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of stars over the pairs that pass in leaves, and over crowded leaves."""
    return near(sets, percent).unionByName(crowds(sets.where(F.length("crowded") > 0).select("node", F.col("crowded").alias("leaves"))))


def near(sets: DataFrame, percent: int) -> DataFrame:
    """Edges of the leaves that few enter: their sets meet with their points."""
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum([len(x) // KEY for x in batch.column("leaves").to_pylist()])
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LEAVES // 2, "right")))
                rows = batch.slice(at, to - at)
                at = to
                data = rows.column("leaves").to_pylist()
                of = np.repeat(np.arange(len(data)), [len(x) // KEY for x in data])
                ids, size = np.asarray(rows.column("node")).astype("<i8"), np.asarray(rows.column("n_shingles")).astype("<i8")
                points = np.frombuffer(b"".join(rows.column("point").to_pylist()), np.uint8).reshape(-1, GROUPS)
                keys = keys_of(b"".join(data))
                out = list(dealt(keys, 4 * parts, keys, ids[of], size[of], points[of]))
                out = [(part, keys, a, b, zlib.compress(c, 1)) for part, keys, a, b, c in out]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.binary() if k else pa.int32()) for k in range(5)], names=["part", "keys", "ids", "sizes", "points"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_part(batches):
            keys, ids, size = (np.frombuffer(b"".join(r[k] for r in rows), kind) for k, kind in enumerate(("<u8", "<i8", "<i8")))
            points = np.frombuffer(b"".join(zlib.decompress(r[3]) for r in rows), np.uint8).reshape(-1, GROUPS)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in close(keys, ids, size, points, percent)], names=["a", "b"])

    packed = sets.where(F.length("leaves") > 0).select("node", "n_shingles", "point", "leaves").mapInArrow(enter, "part int, keys binary, ids binary, sizes binary, points binary")
    return packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(meet, "a long, b long")


def crowds(reps: DataFrame) -> DataFrame:
    """Edges of the leaves that many enter: stars, merged within batches first."""
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names, kinds = ["part", "a", "b"], [pa.int32(), pa.binary(), pa.binary()]

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("leaves").to_pylist()
            keys = keys_of(b"".join(data))
            ids = np.repeat(np.asarray(batch.column("node")), [len(x) // KEY for x in data])
            order, least, new = _stars(keys, ids)
            a, b = _edge_batch(ids[order], least)
            rows = [(-1, a.astype("<i8").tobytes(), b.astype("<i8").tobytes())] if len(a) else []
            rows += dealt(keys[order[new]], 4 * parts, keys[order[new]], ids[order[new]].astype("<i8"))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in by_part(batches):
            for a, b in rows if part < 0 else [(b"".join(r[0] for r in rows), b"".join(r[1] for r in rows))]:
                if part < 0:
                    a, b = np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8")
                else:
                    ids = np.frombuffer(b, "<i8")
                    order, least, _ = _stars(np.frombuffer(a, "<u8"), ids)
                    a, b = _edge_batch(ids[order], least)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    key = F.when(F.col("part") >= 0, F.col("part")).otherwise(F.xxhash64("a"))
    packed = reps.mapInArrow(enter, "part int, a binary, b binary")
    return packed.repartition(parts, key).sortWithinPartitions("part").mapInArrow(meet, "a long, b long")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two lists, by products of their indicator matrices over shared shingles."""
    out = np.zeros((len(left), len(right)), np.float32)
    owner = np.concatenate([np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)])
    side = np.repeat([0, 1], [sum(map(len, left)), sum(map(len, right))])
    value, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    both = (np.bincount(at[side == 0], minlength=len(value)) > 0) & (np.bincount(at[side == 1], minlength=len(value)) > 0)
    column = np.cumsum(both) - 1
    keep = both[at]
    owner, side, at = owner[keep], side[keep], column[at[keep]]
    order = np.argsort(at, kind="stable")
    owner, side, at = owner[order], side[order], at[order]
    for first in range(0, int(both.sum()), 4096):
        a, b = np.searchsorted(at, [first, first + 4096])
        m = [np.zeros((len(x), 4096), np.float32) for x in (left, right)]
        for k in (0, 1):
            pick = side[a:b] == k
            m[k][owner[a:b][pick], at[a:b][pick] - first] = 1
        out += m[0] @ m[1].T
    return out


def boxes(counts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points in the order of their sizes, NODE under one box: that order, the largest counts and the least size of each."""
    order = np.argsort(sizes, kind="stable")
    first = np.arange(0, len(order), NODE)
    return order, np.maximum.reduceat(counts[order], first), sizes[order][first]


def enough(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Pairs whose summed coordinate minima allow a link."""
    out = np.empty((len(a), len(b)), bool)
    for k, row in enumerate(a):
        out[k] = (100 + percent) * np.minimum(row, b).sum(1, dtype=np.int64) >= percent * (size_a[k] + size_b)
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray], percent: int, asked: np.ndarray) -> np.ndarray:
    """Which of the asked pairs link: boxes, then points are met by their summed minima, and what is left is verified on the sets."""
    sizes = [np.array([len(s) for s in x]) for x in (left, right)]
    counts = [np.stack([np.bincount((s & np.uint64(BOUND_GROUPS - 1)).astype(np.int64), minlength=BOUND_GROUPS) for s in x]).astype(np.uint16) for x in (left, right)]
    (order_a, box_a, least_a), (order_b, box_b, least_b) = (boxes(c, n) for c, n in zip(counts, sizes, strict=True))
    maybe = np.zeros((len(left), len(right)), bool)
    meets = enough(box_a, least_a, box_b, least_b, percent)
    for node in np.flatnonzero(meets.any(1)):
        x = order_a[node * NODE : (node + 1) * NODE]
        y = order_b[np.flatnonzero(np.repeat(meets[node], NODE)[: len(order_b)])]
        maybe[np.ix_(x, y)] = enough(counts[0][x], sizes[0][x], counts[1][y], sizes[1][y], percent)
    maybe &= asked
    rows, cols = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
    if not len(rows):
        return maybe
    exact = overlaps([left[k] for k in rows], [right[k] for k in cols]).astype(np.int64)
    total = sizes[0][rows][:, None] + sizes[1][cols][None, :]
    maybe[np.ix_(rows, cols)] &= (100 + percent) * exact >= percent * total
    return maybe


class Forest:
    """A spanning forest of the pairs (i, j) given to it, over n places."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def top(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def tops(self, places: np.ndarray) -> np.ndarray:
        return np.array([self.top(x) for x in places.tolist()])

    def add(self, pairs: np.ndarray) -> None:
        for i, j in pairs.tolist():
            x, y = self.top(i), self.top(j)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                self.links.append((i, j))


def marked(rows: DataFrame, keys: DataFrame, *names: str) -> DataFrame:
    """rows with ``may``: false where none of the keys has these values, so that few rows need a shuffle to be sure.

    The keys' hashes set bits in at most BITS / 32768 bitmaps of 4 kB (8 MB in all, however
    many keys there are); these are broadcast. Beyond that many keys more rows are marked, none less.
    """
    at = F.pmod(F.xxhash64(*names), F.lit(BITS))
    bits = keys.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))
    rows = rows.withColumn("_at", at)
    held = rows.join(F.broadcast(bits), F.bitmap_bucket_number("_at") == F.col("_bucket"), "left")
    place = F.bitmap_bit_position("_at")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    set_ = F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(1) == 1
    return held.withColumn("may", F.coalesce(set_, F.lit(False))).drop("_at", "_bucket", "_bits")


def links(docs: DataFrame, clusters: DataFrame, n: int, percent: int, separators: np.ndarray) -> DataFrame:
    """A spanning forest (a, b) of the verified links within each block pair of a cluster's sets.

    clusters: node, component, and of each node n_shingles, its digest and a row that has it.
    """
    spark = docs.sparkSession
    count = clusters.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"), F.count("*").alias("m")).where("m > 1")
    # members are dealt to a cluster's blocks by hash; a block has BLOCK_SETS sets on average, fewer large ones
    placed = clusters.join(count, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.select("row", "node", "digest", "component", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.select("row", "node", "digest", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    meets = placed.groupBy("row").agg(F.collect_list(F.struct("node", "digest", "component", "i", "j", "own")).alias("meets"))

    names, kinds = ["component", "i", "j", "own", "node", "data"], [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names=names)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            rows, held = [], 0
            for meet, own in zip(block.column("meets").to_pylist(), shingles(block.column("text"), n, separators), strict=True):
                data, digest = own.tobytes(), digest_of(own)
                for m in meet:
                    if m["digest"] != digest:
                        continue
                    rows.append((m["component"], m["i"], m["j"], m["own"], m["node"], data))
                    held += len(data)
                    if held > SENT_BYTES:  # a set goes to many blocks of a large cluster
                        yield batch_of(rows)
                        rows, held = [], 0
            yield batch_of(rows)

    def verify(table: pa.Table) -> pa.Table:
        ids, first = np.unique(np.asarray(table["node"]), return_index=True)  # rows may repeat
        own, data = np.asarray(table["own"])[first], table["data"].combine_chunks()
        data = [np.frombuffer(data[k].as_buffer(), np.uint64) for k in first.tolist()]
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        tied = Forest(len(ids))
        for a in range(0, len(left), BLOCK):
            for b in range(0, a + 1 if i == j else len(right), BLOCK):
                x, y = left[a : a + BLOCK], right[b : b + BLOCK]
                # sets that are tied already need no further link
                asked = tied.tops(x)[:, None] != tied.tops(y)[None, :]
                if i == j and a == b:
                    asked &= np.tri(len(x), k=-1, dtype=bool)
                if asked.any():
                    ok = np.argwhere(linked([data[k] for k in x], [data[k] for k in y], percent, asked))
                    tied.add(np.stack([x[ok[:, 0]], y[ok[:, 1]]], 1))
        return pa.table({"a": pa.array([ids[x] for x, _ in tied.links], pa.int64()), "b": pa.array([ids[y] for _, y in tied.links], pa.int64())})

    rows = marked(row_and_text(docs).select("row", "text"), clusters, "row").where("may").join(meets, "row").select("text", "meets")
    rows = rows.mapInArrow(sets, "component long, i int, j int, own int, node long, data binary")
    return written(spark, rows.groupBy("component", "i", "j").applyInArrow(verify, "a long, b long"), "links")


def grouped(docs: DataFrame, n: int, percent: int, separators: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """The rows (row, doc_id, text_hash, n_shingles, digest), and the classes: digest, copies, the first of their rows, and a component's number."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = written(spark, signed(docs, n, percent, separators, False), "shingle-sets")
    first = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash", "row")
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min(first).alias("first"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"))
    classes = written(spark, classes.withColumn("node", F.xxhash64("digest")), "classes")
    # leaves are made anew rather than stored for every row: they take more room than texts
    own = F.min(F.struct("n_shingles", "leaves", "point")).alias("own")
    held, held_at = leaf_blocks(signed(docs, n, percent, separators, True).where(F.length("leaves") > 0).groupBy("digest").agg(own).select(F.xxhash64("digest").alias("node"), "own.*"))
    released(spark)
    sets, sets_at = stored(spark, entered(held, percent), "leaves-entered")
    dropped(spark, held_at)
    released(spark)
    stars = components(candidates(sets, percent))
    dropped(spark, sets_at)
    released(spark)
    clusters = stars.join(classes.select("node", "n_shingles", "digest", F.col("first.row").alias("row")), "node")
    found = components(links(docs, clusters, n, percent, separators))
    return rows, classes.join(found, "node", "left").select("digest", "copies", "first", F.coalesce("component", "node").alias("component"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, separators: np.ndarray = BLANKS) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links) for every row."""
    spark = docs.sparkSession
    rows, classes = grouped(docs, n, percent, separators)
    least = classes.groupBy("component").agg(F.min("first.doc_id").alias("component_id"))
    named = written(spark, classes.select("digest", "copies", "component").join(least, "component").select("digest", "copies", "component_id"), "classes-named")
    hot = named.where(F.col("copies") * SHARE > rows.count()).select("digest", F.col("component_id").alias("of_hot"), F.lit(True).alias("hot"))
    told = rows.where("digest is not null").select("doc_id", "n_shingles", "digest").join(F.broadcast(hot), "digest", "left")
    rest = told.where("hot is null").select("doc_id", "n_shingles", "digest").join(named.select("digest", "component_id"), "digest").drop("digest")
    alone = rows.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return told.where("hot").select("doc_id", "n_shingles", F.col("of_hot").alias("component_id")).unionByName(rest).unionByName(alone)


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The first row of each group, by doc_id; of rows with one id and one text, one. Rows without words all stay, so do rows without id that nothing resembles."""
    spark = docs.sparkSession
    rows, classes = grouped(docs, n, percent, BLANKS)
    first = classes.groupBy("component").agg(F.min("first").alias("first")).select("first.row", "first.text_hash")
    stays = first.unionByName(rows.where("digest is null").select("row", "text_hash"))
    stays = written(spark, stays, "stays")
    # rows that go, or that repeat; only these, and those taken for one of them, are shuffled with their texts
    doubtful = rows.groupBy("row", "text_hash").agg(F.count("*").alias("n")).join(stays.withColumn("stays", F.lit(True)).distinct(), ["row", "text_hash"], "left").where("n > 1 or stays is null")
    own = F.struct(*(docs[c] for c in docs.columns)).alias("own")
    ids, text = docs["doc_id"].cast("long"), docs["text"].cast("string")
    named = marked(docs.select(F.coalesce(ids, F.xxhash64(text)).alias("row"), F.xxhash64(text).alias("text_hash"), own), doubtful.select("row", "text_hash"), "row", "text_hash")
    sure = named.where("not may").select("own.*")
    return sure.unionByName(named.where("may").join(stays, ["row", "text_hash"], "left_semi").dropDuplicates(["row", "text_hash"]).select("own.*"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), n=3, percent=90)
