"""Operator 12, approximate nearest neighbours: a forest of random-projection trees.

Each tree splits the space by hyperplanes between two random points of a bounded sample, at
the sample's median, down to leaves; every row is indexed in one leaf of each tree. A largest
inner product becomes a least distance by one coordinate more, sqrt(M^2 - |x|^2), M the
longest vector's length.

A query walks all trees through one shared priority queue. The queue holds nodes by the least
margin on their paths, so the leaf that comes next is the most promising of all trees. It
takes leaves until they hold a share of all rows. That share is fitted: the least at which
sampled queries find RECALL of their true neighbours among the sample, where neighbours are
farther apart than in the whole table. Vectors without structure need a large share.

Leaves are bundled to groups of bounded size, large ones split over several; a query goes to
the groups of its leaves. There all rows of its leaves are scored and the best kept, and
the groups' best are ranked again by their exact scores.

Defined results: vectors that are null or zero or hold a null or non-finite component, and
rows without vec_id, take no part; shorter vectors count as filled up with zeros; a query
takes no row of its own vec_id; rows that repeat a vec_id are candidates each, those of equal
score for a query once; no row gives no row; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stored
from .vectors import matrix, sampled, usable

TOP, EVERY = 20, 20
TREES, DEPTH = 8, 9
#: Rows that forests are fitted on, about; queries among them that the share of rows is fitted on.
SAMPLE, TRIALS, RECALL = 8192, 128, 0.95
#: The least sampled rows of a leaf, rows of a group, and queries that meet a group at once.
LEAF, GROUP, QUERIES = 12, 16_384, 4096
#: How far from each other scores may be that rounding tells apart or not, as a share of the lengths' product.
NEAR = 1e-12


class Forest:
    def __init__(self, sample: np.ndarray, longest: float, trees: int = TREES, depth: int = DEPTH, seed: int = 7):
        """sample: some of the vectors; longest: the length of the longest of all."""
        self.longest, rng = longest, np.random.default_rng(seed)
        points = self.lifted(sample)
        depth = min(depth, max(0, int(np.log2(max(1, len(points) / LEAF)))))
        self.trees, self.depth, self.leaves = trees, depth, 1 << depth
        self.planes, self.cuts = np.zeros((trees, self.leaves - 1, points.shape[1])), np.zeros((trees, self.leaves - 1))
        for t in range(trees):
            rows = [np.arange(len(points))]
            for node in range(self.leaves - 1):
                own = rows[node]
                plane = rng.standard_normal(points.shape[1])
                if len(own) > 1:
                    a, b = points[rng.choice(own, 2, replace=False)]
                    plane = a - b if (a != b).any() else plane
                plane /= np.linalg.norm(plane)
                at = points[own] @ plane
                self.planes[t, node], self.cuts[t, node] = plane, np.median(at) if len(own) else 0.0
                right = at >= self.cuts[t, node]
                rows += [own[~right], own[right]]

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(self.longest**2 - (vectors * vectors).sum(1), 0))
        return np.concatenate([vectors, more[:, None]], 1)

    def leaf(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        points = self.lifted(vectors)
        out = np.empty((len(points), self.trees), np.int64)
        for t in range(self.trees):
            node = np.zeros(len(points), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + ((points * self.planes[t][node]).sum(1) >= self.cuts[t][node])
            out[:, t] = node - (self.leaves - 1)
        return out

    def taken(self, queries: np.ndarray, sizes: np.ndarray, most: float) -> Iterator[np.ndarray]:
        """For each query the leaves (tree * leaves + leaf) that the shared queue gives, best first, until they hold ``most`` rows."""
        lifted = np.concatenate([queries, np.zeros((len(queries), 1))], 1)
        inner = self.leaves - 1
        for q in lifted:
            margins = (self.planes @ q - self.cuts).tolist()
            queue = [(-np.inf, t, 0) for t in range(self.trees)]
            held, out = 0, []
            while queue and held < most:
                reach, t, node = heapq.heappop(queue)
                # down to a leaf along the query's own side; the other sides wait in the queue
                while node < inner:
                    m = margins[t][node]
                    left, right = max(reach, m), max(reach, -m)
                    near, other = (2 * node + 2, (left, t, 2 * node + 1)) if m >= 0 else (2 * node + 1, (right, t, 2 * node + 2))
                    heapq.heappush(queue, other)
                    reach = min(left, right)
                    node = near
                if sizes[t, node - inner]:
                    out.append(t * self.leaves + node - inner)
                    held += sizes[t, node - inner]
            yield np.array(out, np.int64)

    def share(self, sample: np.ndarray, recall: float = RECALL, top: int = TOP, trials: int = TRIALS) -> float:
        """The least share of all rows whose leaves hold ``recall`` of the true neighbours, for queries of the sample."""
        top = min(top, len(sample) - 1)
        if top < 1:
            return 1.0
        leaf = self.leaf(sample)
        sizes = np.stack([np.bincount(leaf[:, t], minlength=self.leaves) for t in range(self.trees)])
        at = np.linspace(0, len(sample) - 1, min(trials, len(sample))).astype(int)
        scores = sample[at] @ sample.T
        scores[np.arange(len(at)), at] = -np.inf
        true = np.argpartition(-scores, top - 1, axis=1)[:, :top]
        needed = []
        for own, order in zip(true, self.taken(sample[at], sizes, np.inf), strict=True):
            held = np.full(sizes.size, np.inf)
            held[order] = np.cumsum(sizes.ravel()[order])
            needed.append(held.reshape(sizes.shape)[np.arange(self.trees), leaf[own]].min(1))
        needed = np.sort(np.concatenate(needed)) / len(sample)
        return float(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


class Layout:
    """Which groups hold the rows of each leaf."""

    def __init__(self, sizes: np.ndarray, group: int):
        """sizes: rows of each leaf of all trees, in order."""
        self.first, self.parts = np.zeros(sizes.size, np.int64), np.ones(sizes.size, np.int64)
        at = held = 0
        for k, n in enumerate(sizes.ravel().tolist()):
            if held and held + n > group:
                at, held = at + 1, 0
            self.first[k], self.parts[k] = at, max(1, -(-n // group))
            if n > group:  # a large leaf has groups of its own
                at, held = at + self.parts[k], 0
            else:
                held += n


def best_of(queries: np.ndarray, own: np.ndarray, leaves: list[np.ndarray], leaf: np.ndarray, ids: np.ndarray, vectors: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best rows of a group for each query: which query, which row, and the exact score.

    own: the queries' ids; leaves: the leaves each takes; leaf, ids, vectors: the rows'.
    """
    order = np.lexsort((ids, leaf))
    ends = np.append(np.flatnonzero(np.concatenate([[True], leaf[order][1:] != leaf[order][:-1]])), len(order))
    asks = np.concatenate(leaves)
    asking = np.repeat(np.arange(len(leaves)), [len(x) for x in leaves])
    turn = np.argsort(asks, kind="stable")
    asks, asking = asks[turn], asking[turn]
    width = top + 1
    best, rows = np.full((len(queries), width), -np.inf), np.full((len(queries), width), -1)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        first, last = np.searchsorted(asks, [leaf[order[a]], leaf[order[a]] + 1])
        of = asking[first:last]
        if not len(of):
            continue
        for at in range(a, b, 2048):
            few = order[at : min(b, at + 2048)]
            scores = queries[of] @ vectors[few].T
            scores[own[of][:, None] == ids[few][None]] = -np.inf
            scores, found = np.concatenate([best[of], scores], 1), np.concatenate([rows[of], np.broadcast_to(few, (len(of), len(few)))], 1)
            if scores.shape[1] > 4 * width:  # only what reaches the cut, with what rounding may hide, is sorted
                cut = np.partition(scores, -width, 1)[:, -width]
                room = int((scores >= (cut - NEAR * (1 + np.abs(cut)))[:, None]).sum(1).max())
                keep = np.argpartition(-scores, min(room, scores.shape[1] - 1), 1)[:, : max(room, width)]
                scores, found = np.take_along_axis(scores, keep, 1), np.take_along_axis(found, keep, 1)
            # scores that differ by rounding alone count as equal, so that ids decide
            sort = np.lexsort((np.where(found >= 0, ids[found], np.iinfo(np.int64).max), -np.round(scores, 12)), axis=1)[:, :width]
            best[of], rows[of] = np.take_along_axis(scores, sort, 1), np.take_along_axis(found, sort, 1)
    q, k = np.nonzero(best > -np.inf)
    at = rows[q, k]
    return q, at, (queries[q] * vectors[at]).sum(1)


INDEXED = "group long, leaf long, vec_id long, vector binary"
ASKING = "group long, qid long, query_id long, leaves binary, vector binary"
FOUND = "qid long, query_id long, vec_id long, score double"


def neighbours(rows: DataFrame, every: int = EVERY, top: int = TOP, trees: int = TREES, depth: int = DEPTH, share: float | None = None, group: int = GROUP, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found of each row whose vec_id ``every`` divides. rows: vec_id, embedding.

    share: of all rows, how many a query's leaves hold; None: as fitted.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    rows = usable(rows).drop("label").where(F.exists("embedding", lambda x: x != 0))
    schema = "query_id long, rank int, vec_id long, score double"
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("most")).first()
    n, width = size["n"], size["width"]
    if not n:
        return spark.createDataFrame([], schema)
    sample = sampled(rows, n, SAMPLE, width)
    if not len(sample):
        sample = np.zeros((1, width))
    forest = Forest(sample, float(np.sqrt(size["most"])), trees, depth)
    most = n * (forest.share(sample, top=top) if share is None else share)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(forest.trees * forest.leaves, np.int64)
        for batch in batches:
            leaf = forest.leaf(matrix(batch.column("embedding"), width))
            total += np.bincount((leaf + np.arange(forest.trees) * forest.leaves).ravel(), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["leaf", "n"])

    # at most trees * leaves rows come back
    sizes = np.zeros(forest.trees * forest.leaves, np.int64)
    for r in rows.select("embedding").mapInArrow(counted, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        sizes[r["leaf"]] = r["n"]
    layout = Layout(sizes, min(group, max(512, forest.trees * n // (2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    shape = sizes.reshape(forest.trees, forest.leaves)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column("embedding"), width)
            leaf = (forest.leaf(vectors) + np.arange(forest.trees) * forest.leaves).ravel()
            of = np.repeat(np.arange(batch.num_rows), forest.trees)
            salt = np.asarray(batch.column("salt")).astype(np.uint64)[of] % layout.parts[leaf].astype(np.uint64)
            kept = pa.array([v.tobytes() for v in vectors], pa.binary()).take(pa.array(of))
            yield pa.RecordBatch.from_arrays([pa.array(layout.first[leaf] + salt.astype(np.int64)), pa.array(leaf), batch.column("vec_id").take(pa.array(of)), kept], names=["group", "leaf", "vec_id", "vector"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                vectors = matrix(batch.column("embedding"), width)
                out: list[tuple] = []
                for k, leaves in enumerate(forest.taken(vectors, shape, most)):
                    spread = np.repeat(leaves, layout.parts[leaves])
                    groups = np.repeat(layout.first[leaves], layout.parts[leaves]) + np.arange(len(spread)) - np.repeat(np.cumsum(layout.parts[leaves]) - layout.parts[leaves], layout.parts[leaves])
                    order = np.argsort(groups, kind="stable")
                    cuts = np.flatnonzero(np.diff(groups[order])) + 1
                    out += [(int(groups[g[0]]), k, spread[g].tobytes()) for g in np.split(order, cuts) if len(g)]
                of = pa.array([r[1] for r in out], pa.int64())
                kept = pa.array([v.tobytes() for v in vectors], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), batch.column("qid").take(of), batch.column("vec_id").take(of), pa.array([r[2] for r in out], pa.binary()), kept.take(of)], names=["group", "qid", "query_id", "leaves", "vector"])

    def searched(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in FOUND.split(", ")]
        if not left.num_rows or not right.num_rows:
            return pa.table({k: pa.array([], t) for k, t in zip(names, [pa.int64()] * 3 + [pa.float64()], strict=True)})
        opened = lambda t: np.frombuffer(b"".join(t["vector"].to_pylist())).reshape(t.num_rows, width)
        leaves = [np.frombuffer(x, np.int64) for x in left["leaves"].to_pylist()]
        ids = np.asarray(right["vec_id"])
        q, at, score = best_of(opened(left), np.asarray(left["query_id"]), leaves, np.asarray(right["leaf"]), ids, opened(right), top)
        return pa.table({"qid": left["qid"].take(pa.array(q)), "query_id": left["query_id"].take(pa.array(q)), "vec_id": pa.array(ids[at], pa.int64()), "score": pa.array(score)})

    queries = rows.where(F.col("vec_id") % every == 0).withColumn("qid", F.shiftrightunsigned(F.xxhash64("vec_id", "embedding"), 1)).dropDuplicates(["qid"])
    queries, _ = stored(spark, queries, "queries")
    blocks = max(1, -(-queries.count() // block))
    # few rows, but much work for each
    asking = queries.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "qid").mapInArrow(asked, ASKING).withColumn("block", F.pmod("qid", F.lit(blocks)))
    index = rows.withColumn("salt", F.xxhash64("vec_id", "embedding")).mapInArrow(indexed, INDEXED)
    if blocks > 1:
        index = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    else:
        index = index.withColumn("block", F.lit(0).cast("long"))
    found = asking.groupBy("group", "block").cogroup(index.groupBy("group", "block")).applyInArrow(searched, FOUND)
    # a row is found once in each tree
    order = Window.partitionBy("query_id", "qid").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= top).dropDuplicates(["query_id", "qid", "rank"])
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
