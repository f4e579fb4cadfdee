"""Operator 11, hard-negative mining: a GNAT-style multiway hyperplane tree.

The root has up to CELLS split points from a bounded sample; a row belongs to the cell of its
nearest one, and for every split point and cell the range of distances is kept (one aggregate
over all rows). Below a cell rows are dealt to chunks of bounded size; each chunk is a tree of
its own with ARITY split points a node, each with its ranges of distances to the siblings'
subtrees. The chunks are a stored table, built once and searched three times.

A query asks for scores between two bounds, that is, for an annulus around its vector. A
subtree goes where its range around a split point, shifted by the query's distance to that
point, doesn't meet the annulus; the root decides which chunks a query is sent to. Leaves
compute integer scores exactly. First each anchor learns a bound for its positives from one
chunk of its own cell, then positives are searched, then negatives within their windows.

Anchors meet chunks in blocks of at most QUERIES x CHUNK rows. Vectors without structure let
no subtree go: then all anchors are held against all rows, in blocks.

Defined results: rows with a null vec_id, label or vector, or with a null or non-finite
component, take no part; shorter vectors count as filled up with zeros; an anchor's positives
are rows of another vec_id; rows that repeat a vec_id are candidates each, and repeated rows
with one vec_id, label and vector are one anchor; no row gives no row; other columns are not
read. Components of 2 ** 31 or more after scaling stop the job, as do scores beyond 64 bits.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stored
from .vectors import matrix, sampled, usable

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
SCALE = 256
EVERY = 50
CELLS, SAMPLE = 64, 4096
#: The most rows of a chunk, and of anchors that it is searched for at once.
CHUNK, QUERIES = 8192, 4096
ARITY, LEAF = 8, 64


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows of a and b."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return a @ b.T
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0))


def slack(scale: float) -> float:
    """What rounding can add to a distance."""
    return 1e-6 * (1 + scale)


def spread(points: np.ndarray, n: int) -> np.ndarray:
    """Places of n points far from each other: each next one is farthest from those before."""
    chosen = [0]
    far = distances(points, points[:1])[:, 0]
    while len(chosen) < min(n, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(points, points[chosen[-1] :][:1])[:, 0])
    return np.array(chosen)


def meets(to_points: np.ndarray, low: np.ndarray, high: np.ndarray, near: np.ndarray, far: np.ndarray, spare: float) -> np.ndarray:
    """Which subtrees (columns) can hold points between ``near`` and ``far`` of each query.

    to_points: distances of queries to split points; low, high: ranges of split points (rows) to subtrees.
    """
    least = np.maximum(low[None] - to_points[:, :, None], to_points[:, :, None] - high[None]).max(1)
    most = (to_points[:, :, None] + high[None]).min(1)
    return (least <= far[:, None] + spare) & (most >= near[:, None] - spare)


class Tree:
    """A multiway hyperplane tree over a bounded number of integer vectors; leaves are slices of their new order."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.leaf, self.order = leaf, []
        self.root, n = self._built(vectors, np.arange(len(vectors)), 0)
        self.order = np.concatenate(self.order) if self.order else np.empty(0, np.int64)

    def _built(self, vectors: np.ndarray, at: np.ndarray, first: int) -> tuple[tuple, int]:
        """(first, last) of a leaf, or (split points, ranges, children); and where its rows end."""
        picks = spread(vectors[at[:: max(1, len(at) // (3 * ARITY))]], ARITY) if len(at) > self.leaf else ()
        if len(picks) < 2:
            self.order.append(at)
            return (first, first + len(at)), first + len(at)
        points = vectors[at[:: max(1, len(at) // (3 * ARITY))][picks]]
        far = distances(vectors[at], points)
        own = far.argmin(1)
        groups = [np.flatnonzero(own == k) for k in range(len(points))]
        low = np.stack([far[g].min(0, initial=np.inf) for g in groups], 1)
        high = np.stack([far[g].max(0, initial=-np.inf) for g in groups], 1)
        children = []
        for g in groups:
            child, first = self._built(vectors, at[g], first)
            children.append(child)
        return (points, low, high, children), first

    def leaves(self, queries: np.ndarray, near: np.ndarray, far: np.ndarray, spare: float) -> Iterator[tuple[int, int, np.ndarray]]:
        """Leaves, and the queries whose annulus they may meet."""
        todo = [(self.root, np.arange(len(queries)))]
        while todo:
            node, of = todo.pop()
            if not len(of):
                continue
            if len(node) == 2:
                yield *node, of
                continue
            points, low, high, children = node
            ok = meets(distances(queries[of], points), low, high, near[of], far[of], spare)
            todo += [(child, of[ok[:, k]]) for k, child in enumerate(children)]


class Chunk:
    """Rows of one chunk under their tree, sorted by it."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.tree = Tree(vectors)
        self.ids, self.labels, self.vectors = ids[self.tree.order], labels[self.tree.order], vectors[self.tree.order]
        self.norms = (self.vectors.astype(np.float64) ** 2).sum(1)

    def scores(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of queries (rows) with rows of the chunk, and which of them were computed: all between the bounds are."""
        own = (queries.astype(np.float64) ** 2).sum(1)
        near = np.sqrt(np.maximum(own + self.norms.min() - 2 * high, 0))
        far = np.sqrt(np.maximum(own + self.norms.max() - 2 * low, 0))
        spare = slack(float(np.sqrt(max(own.max(), self.norms.max()))))
        out, known = np.zeros((len(queries), len(self.ids)), np.int64), np.zeros((len(queries), len(self.ids)), bool)
        for first, last, of in self.tree.leaves(queries, near, far, spare):
            out[of, first:last] = products(queries[of], self.vectors[first:last])
            known[of, first:last] = True
        return out, known


class Root:
    """The root's split points and its ranges to the cells, with the rows of each and the chunks they are dealt to."""

    def __init__(self, points: np.ndarray):
        self.points = points

    def cell(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = distances(vectors, self.points)
        return far.argmin(1), far

    def measured(self, found: list, chunk: int) -> None:
        n = len(self.points)
        self.low, self.high = np.full((n, n), np.inf), np.full((n, n), -np.inf)
        self.norms, self.rows = np.zeros((n, 2)), np.zeros(n, np.int64)
        for r in found:
            self.low[r["point"], r["cell"]], self.high[r["point"], r["cell"]] = r["low"], r["high"]
            self.norms[r["cell"]], self.rows[r["cell"]] = (r["least"], r["most"]), r["n"]
        self.chunks = -(-self.rows // chunk)
        self.first = np.concatenate([[0], np.cumsum(self.chunks)])

    def chunks_met(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
        """The chunks that each query is sent to."""
        own = (queries.astype(np.float64) ** 2).sum(1)
        near = np.sqrt(np.maximum(own[:, None] + self.norms[:, 0] - 2 * high[:, None], 0))
        far = np.sqrt(np.maximum(own[:, None] + self.norms[:, 1] - 2 * low[:, None], 0))
        to_points = distances(queries, self.points)
        spare = slack(float(np.sqrt(max(own.max(initial=0), self.norms.max(initial=0)))))
        least = np.maximum(self.low[None] - to_points[:, :, None], to_points[:, :, None] - self.high[None]).max(1)
        most = (to_points[:, :, None] + self.high[None]).min(1)
        ok = (least <= far + spare) & (most >= near - spare) & (self.rows > 0)
        return [np.concatenate([np.arange(self.first[c], self.first[c + 1]) for c in np.flatnonzero(row)] or [np.empty(0, np.int64)]) for row in ok]


INDEXED = "chunk long, vec_id long, label long, vector binary"


def integers(column: pa.Array, width: int) -> np.ndarray:
    return np.floor(SCALE * matrix(column, width)).astype(np.int64)


class Index:
    """All rows of a table, stored as chunks under one root."""

    def __init__(self, rows: DataFrame, cells: int = CELLS, chunk: int = CHUNK):
        """rows: vec_id, label, embedding; all usable."""
        self.spark = spark = rows.sparkSession
        bounded_batches(spark)
        size = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width"), F.max(F.array_max(F.transform("embedding", F.abs))).alias("most")).first()
        self.n, width = size["n"], size["width"] or 0
        self.width = width
        if (size["most"] or 0) * SCALE >= 2**31:
            raise ArithmeticError("a component is too large to be scored in 64 bits")
        if not self.n:
            return
        # small tables are cut finer, so that all tasks have chunks
        chunk = min(chunk, max(256, self.n // (2 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
        points = np.floor(SCALE * sampled(rows, self.n, SAMPLE, width)).astype(np.int64)
        points = points if len(points) else np.zeros((1, width), np.int64)
        root = Root(points[spread(points, max(1, min(cells, self.n // LEAF)))])

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = len(root.points)
            low, high = np.full((n, n), np.inf), np.full((n, n), -np.inf)
            least, most, count = np.full(n, np.inf), np.zeros(n), np.zeros(n, np.int64)
            for batch in batches:
                vectors = integers(batch.column("embedding"), width)
                own, far = root.cell(vectors)
                norms = (vectors.astype(np.float64) ** 2).sum(1)
                for c in np.unique(own):
                    mine = own == c
                    low[:, c], high[:, c] = np.minimum(low[:, c], far[mine].min(0)), np.maximum(high[:, c], far[mine].max(0))
                    least[c], most[c], count[c] = min(least[c], norms[mine].min()), max(most[c], norms[mine].max()), count[c] + mine.sum()
            there = np.flatnonzero(count)
            cell, point = np.repeat(there, n), np.tile(np.arange(n), len(there))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cell, point, low[point, cell], high[point, cell], least[cell], most[cell], count[cell])], names=["cell", "point", "low", "high", "least", "most", "n"])

        found = rows.select("embedding").mapInArrow(ranges, "cell long, point long, low double, high double, least double, most double, n long")
        root.measured(found.groupBy("cell", "point").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n")).collect(), chunk)
        self.root = root

        def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = integers(batch.column("embedding"), width)
                own, _ = root.cell(vectors)
                salt = np.asarray(batch.column("salt")).astype(np.uint64) % root.chunks[own].astype(np.uint64)
                kept = pa.array([v.tobytes() for v in vectors.astype("<i4")], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(root.first[own] + salt.astype(np.int64)), batch.column("vec_id"), batch.column("label"), kept], names=["chunk", "vec_id", "label", "vector"])

        def built(table: pa.Table) -> pa.Table:
            vectors = np.frombuffer(b"".join(table["vector"].to_pylist()), "<i4").reshape(table.num_rows, width).astype(np.int64)
            chunk = Chunk(np.asarray(table["vec_id"]), np.asarray(table["label"]), vectors)
            return pa.table({"chunk": table["chunk"][:1], "data": pa.array([pickle.dumps(chunk)], pa.binary())})

        dealt = rows.withColumn("salt", F.xxhash64("vec_id", "label", "embedding")).mapInArrow(indexed, INDEXED)
        self.chunks, self.path = stored(spark, dealt.groupBy("chunk").applyInArrow(built, "chunk long, data binary"), "gnat-chunks")

    def sent(self, queries: DataFrame, home: bool = False) -> DataFrame:
        """Rows of queries (qid, vec_id, label, vector, low, high) for each chunk they are sent to; ``home``: one of their own cell."""
        root, width = self.root, self.width

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    vectors = np.frombuffer(b"".join(batch.column("vector").to_pylist()), "<i4").reshape(-1, width).astype(np.int64)
                    if home:
                        own, _ = root.cell(vectors)
                        to = [np.array([x]) for x in root.first[own] + np.asarray(batch.column("qid")).astype(np.uint64) % root.chunks[own].astype(np.uint64)]
                    else:
                        to = root.chunks_met(vectors, np.asarray(batch.column("low")), np.asarray(batch.column("high")))
                    of = np.repeat(np.arange(batch.num_rows), [len(x) for x in to])
                    rows = batch.take(pa.array(of))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to).astype(np.int64)), *rows.columns], names=["chunk", *batch.schema.names])

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema.fields)
        return queries.mapInArrow(route, f"chunk long, {fields}")

    def searched(self, queries: DataFrame, total: int, find, schema: str, home: bool = False) -> DataFrame:
        """``find(table of queries, chunk)`` for each chunk and each block of the queries that are sent to it."""
        blocks = max(1, -(-total // QUERIES))
        sent = self.sent(queries, home).withColumn("block", F.pmod("qid", F.lit(blocks)))
        chunks = self.chunks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

        def task(left: pa.Table, right: pa.Table) -> pa.Table:
            names = [c.split()[0] for c in schema.split(", ")]
            if not left.num_rows or not right.num_rows:
                return pa.table({n: pa.array([], pa.int64()) for n in names})
            rows = find(left, pickle.loads(right["data"][0].as_py()))
            return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, rows, strict=True)})

        return sent.groupBy("chunk", "block").cogroup(chunks.groupBy("chunk", "block")).applyInArrow(task, schema)


def vectors_of(table: pa.Table) -> np.ndarray:
    return np.stack([np.frombuffer(v, "<i4") for v in table["vector"].to_pylist()]).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n first by score, ties by smaller id."""
    if len(scores) > 4 * n:
        cut = np.partition(scores, len(scores) - n)[len(scores) - n]
        few = np.flatnonzero(scores >= cut)
        return few[np.lexsort((ids[few], -scores[few]))[:n]]
    return np.lexsort((ids, -scores))[:n]


_NONE = -(2.0**62)


def positives_in(queries: pa.Table, chunk: Chunk) -> tuple:
    """For each query the chunk's first POSITIVES rows of its label and another id: qid, vec_id, score."""
    ids, labels, low = np.asarray(queries["vec_id"]), np.asarray(queries["label"]), np.asarray(queries["low"])
    scores, known = chunk.scores(vectors_of(queries), low, np.asarray(queries["high"]))
    out = [np.empty((0, 3), np.int64)]
    for k, qid in enumerate(np.asarray(queries["qid"]).tolist()):
        at = np.flatnonzero(known[k] & (chunk.labels == labels[k]) & (chunk.ids != ids[k]) & (scores[k] >= low[k]))
        at = at[best(scores[k, at], chunk.ids[at], POSITIVES)]
        out.append(np.stack([np.full(len(at), qid), chunk.ids[at], scores[k, at]], 1))
    return tuple(np.concatenate(out).T)


def negatives_in(queries: pa.Table, chunk: Chunk) -> tuple:
    """For each query and positive the chunk's first NEGATIVES rows of other labels in the window: qid, turn, vec_id, score."""
    labels, wanted = np.asarray(queries["label"]), queries["scores"].to_pylist()
    scores, known = chunk.scores(vectors_of(queries), np.asarray(queries["low"]), np.asarray(queries["high"]))
    out = [np.empty((0, 4), np.int64)]
    for k, qid in enumerate(np.asarray(queries["qid"]).tolist()):
        at = np.flatnonzero(known[k] & (chunk.labels != labels[k]))
        at = at[np.lexsort((chunk.ids[at], -scores[k, at]))]
        down = -scores[k, at]
        for turn, score in enumerate(wanted[k]):
            first = np.searchsorted(down, -(HIGH * score // 100), "left")
            last = np.searchsorted(down, -(-(-LOW * score // 100)), "right")
            own = at[first : min(last, first + NEGATIVES)]
            out.append(np.stack([np.full(len(own), qid), np.full(len(own), turn), chunk.ids[own], scores[k, own]], 1))
    return tuple(np.concatenate(out).T)


def mined(rows: DataFrame, every: int = EVERY, cells: int = CELLS, chunk: int = CHUNK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchors are rows whose vec_id ``every`` divides.

    rows: vec_id, label, embedding, as they are to be scored.
    """
    spark = rows.sparkSession
    rows = usable(rows).where("label is not null")
    index = Index(rows, cells, chunk)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not index.n:
        return spark.createDataFrame([], schema)
    width = index.width

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = pa.array([v.tobytes() for v in integers(batch.column("embedding"), width).astype("<i4")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("vec_id"), batch.column("label"), kept], names=["qid", "vec_id", "label", "vector"])

    anchors = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "label", "embedding"])
    anchors = anchors.withColumn("qid", F.shiftrightunsigned(F.xxhash64("vec_id", "label", "embedding"), 1)).mapInArrow(packed, "qid long, vec_id long, label long, vector binary")
    anchors, _ = stored(spark, anchors, "anchors")
    total = anchors.count()
    open_ = anchors.withColumns({"low": F.lit(_NONE), "high": F.lit(-_NONE)})
    found = "qid long, vec_id long, score long"
    by_score = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    # the last of a full set of positives in one chunk of the own cell bounds those of the whole table
    bounds = index.searched(open_, total, positives_in, found, home=True).groupBy("qid").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    bounds = bounds.where(F.col("n") >= POSITIVES).select("qid", F.col("least").cast("double").alias("low"))
    asked = anchors.join(bounds, "qid", "left").select("qid", "vec_id", "label", "vector", F.coalesce("low", F.lit(_NONE)).alias("low"), F.lit(-_NONE).alias("high"))
    positives = index.searched(asked, total, positives_in, found).withColumn("turn", F.row_number().over(by_score) - 1).where(F.col("turn") < POSITIVES)
    positives, _ = stored(spark, positives.select("qid", F.col("turn").cast("long").alias("turn"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    windows = positives.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    windows = windows.withColumns({"low": F.array_min("scores") * (LOW / 100) - 1, "high": F.array_max("scores") * (HIGH / 100) + 1})
    asked = anchors.join(windows, "qid").select("qid", "vec_id", "label", "vector", "low", "high", "scores")
    negatives = index.searched(asked, total, negatives_in, "qid long, turn long, vec_id long, score long")
    order = Window.partitionBy("qid", "turn").orderBy(F.desc("score"), "vec_id")
    negatives = negatives.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES)
    out = negatives.join(positives, ["qid", "turn"]).join(anchors.select("qid", F.col("vec_id").alias("anchor_id")), "qid")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(rows["vec_id"] % 7 == 0, (rows["label"] + 1) % 10).otherwise(rows["label"])
    return mined(rows.select("vec_id", label.alias("label"), "embedding"))


#: The same in DuckDB SQL.
SQL = """
with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * x::double) for x in embedding] as v from embeddings
           where label is not null and embedding is not null and not list_contains([x is null or not isfinite(x) for x in embedding], true)),
s as (select a.vec_id as anchor_id, a.label = r.label as same, r.vec_id, cast(list_dot_product(a.v, r.v) as bigint) as score from r a join r on a.vec_id % 50 = 0 and r.vec_id <> a.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select p.*, s.vec_id as negative_id, s.score as negative_score, cast(row_number() over (partition by anchor_id, positive_id order by s.score desc, s.vec_id) as int) as rank
      from p join s using (anchor_id) where not s.same and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3
"""
