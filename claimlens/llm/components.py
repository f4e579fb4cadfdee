"""Connected components of a graph given as an edge table, by label rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored, written

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reached) for every node of the edges (a, b).

    Each round contracts the graph: every node points to its least neighbour, pointers are
    followed once more, and edges are renamed to what their ends point to, so paths shorten
    by half or more and a hub's edges become loops that vanish.
    """
    spark = edges.sparkSession
    edges, at = stored(spark, edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    pointers, used = [], []
    for _ in range(MOST_ROUNDS):
        if edges.isEmpty():
            break
        # the larger end points to the smaller: no cycles, and pointers lead down
        least, least_at = stored(spark, edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to")), "pointers")
        twice = least.join(least.select(F.col("node").alias("to"), F.col("to").alias("to2")), "to", "left").select("node", F.coalesce("to2", "to").alias("to"))
        step, step_at = stored(spark, twice, "pointers")
        pointers.append(step)
        used.append(step_at)
        left = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a", "left").join(step.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b", "left")
        left = left.select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b"))
        edges, new_at = stored(spark, left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
        dropped(spark, least_at, at)
        at = new_at
    else:
        raise RuntimeError("components did not settle")
    dropped(spark, at)
    if not pointers:
        return spark.createDataFrame([], "node long, component long")
    # later pointers extend earlier ones
    found = pointers[-1].select("node", F.col("to").alias("component"))
    for step in reversed(pointers[:-1]):
        moved = step.join(found.select(F.col("node").alias("to"), "component"), "to", "left").select("node", F.coalesce("component", "to").alias("component"))
        rest = found.join(step.select("node"), "node", "left_anti")
        found, found_at = stored(spark, moved.unionByName(rest), "components")
        used.append(found_at)
    roots = found.select(F.col("component").alias("node")).distinct().join(found.select("node"), "node", "left_anti").withColumn("component", F.col("node"))
    out = written(spark, found.unionByName(roots), "components")
    dropped(spark, *used)
    return out
