"""Operator 6, chat formatting: reply trees.

Messages name the message they reply to. Rounds of self-joins double the reach of every
message's ancestor (as many rounds as the logarithm of the longest path), summing scores
on the way; leaves of a tree are ranked by the score of their path, and each chosen leaf's
ancestors are enumerated by the same jump tables, then formatted as one conversation.

Turns are marked ``<|role|>`` and ``<|end|>``. In roles and texts a backslash is doubled
and each control string gets a backslash after its first character, so no text holds one
and the escape is undone exactly.

Defined results: null texts and roles count as empty; messages without conv_id are one
conversation, whose conv_id is null; a message's node is never null; messages that repeat an id of their
conversation are numbered on in order of role and text, so none is lost; a reply to a
message that isn't there begins a tree of its own; equal scores rank by the leaf's id; an
empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: Control strings of common templates, and of this one ("<|").
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile(r"\\|" + "|".join(re.escape(c) for c in CONTROL))
_TURN = re.compile(r"<\|((?:[^|\\]|\\.|\|(?!>))*)\|>\n(.*?)<\|end\|>\n", re.S)
MOST_ROUNDS = 40

SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, formatted string, loss_spans array<array<long>>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of a conversation and the stretches of it that bear loss: the assistant's texts."""
    out, at, loss = [], 0, []
    for role, text in turns:
        head, body = f"<|{escape(role).replace('|', chr(92) + '|') if role else ''}|>\n", escape(text)
        out += [head, body, "<|end|>\n"]
        at += len(head)
        if role == "assistant":
            loss.append((at, at + len(body)))
        at += len(body) + 8
    return "".join(out), loss


def turns_of(text: str) -> list[tuple[str, str]]:
    """The turns read back from a formatted text."""
    return [(unescape(m[1].replace("\\|", "|")), unescape(m[2])) for m in _TURN.finditer(text)]


def paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """The messages of each tree's best root-to-leaf paths: conv_id, leaf, rank, depth (from 0 at the root), node.

    messages: conv_id, node, parent (null at a root), score. ``branches`` paths are kept for
    each conversation (None: all).
    """
    return named(_paths(keyed(messages), branches))


#: A conversation's key: plain equality never joins null with null.
KEY = ["unnamed", "conv"]


def keyed(messages: DataFrame) -> DataFrame:
    return messages.withColumns({"unnamed": F.col("conv_id").isNull(), "conv": F.coalesce("conv_id", F.lit(0).cast("long"))}).drop("conv_id")


def named(rows: DataFrame) -> DataFrame:
    others = [c for c in rows.columns if c not in KEY]
    return rows.select(F.when(~F.col("unnamed"), F.col("conv")).alias("conv_id"), *others)


def _paths(messages: DataFrame, branches: int | None) -> DataFrame:
    spark = messages.sparkSession
    nodes = messages.select(*KEY, "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = nodes.select(*KEY, F.col("node").alias("parent"), F.lit(True).alias("there"))
    base = nodes.join(known, [*KEY, "parent"], "left").withColumn("up", F.when(F.col("there"), F.col("parent")))
    # jump: from a node to the ancestor 2**k above, with the score and count of the nodes passed
    jump = written(spark, base.select(*KEY, "node", "up", "score", F.lit(1).cast("long").alias("steps")), "reply-jumps")
    leaf = jump.join(jump.select(*KEY, F.col("up").alias("node")).where("node is not null").distinct(), [*KEY, "node"], "left_anti").select(*KEY, F.col("node").alias("leaf"))
    jumps = []
    for _ in range(MOST_ROUNDS):
        jumps.append(jump)
        if jump.where("up is not null").isEmpty():
            break
        above = jump.select(*KEY, F.col("node").alias("up"), F.col("up").alias("up2"), F.col("score").alias("score2"), F.col("steps").alias("steps2"))
        # messages that have reached their root stay as they are: only those of longer paths are joined on
        joined = jump.where("up is not null").join(above, [*KEY, "up"], "left")
        moved = joined.select(*KEY, "node", F.col("up2").alias("up"), (F.col("score") + F.coalesce("score2", F.lit(0.0))).alias("score"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"))
        jump = written(spark, moved.unionByName(jump.where("up is null")), "reply-jumps")
    else:
        raise ValueError("replies form a cycle")
    ranked = jump.join(leaf.withColumnRenamed("leaf", "node"), [*KEY, "node"], "left_semi")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("score"), "node")))
    if branches is not None:
        ranked = ranked.where(F.col("rank") <= branches)
    # each round is a table of its own: a union must not pass on its parts' partitioning
    reached = written(spark, ranked.select(*KEY, F.col("node").alias("leaf"), "rank", "steps", "node", F.lit(0).cast("long").alias("above")), "reply-paths")
    for k, step in enumerate(jumps[:-1]):
        up = step.where("up is not null").select(*KEY, "node", "up")
        more = reached.join(up, [*KEY, "node"]).select(*KEY, "leaf", "rank", "steps", F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above"))
        reached = written(spark, reached.unionByName(more), "reply-paths")
    return reached.select(*KEY, "leaf", "rank", (F.col("steps") - 1 - F.col("above")).alias("depth"), "node")


def conversations_of(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """Each chosen path formatted as one conversation; see SCHEMA. messages: conv_id, node, parent, score, role, text."""
    messages = keyed(messages)
    chosen = _paths(messages, branches)
    texts = messages.select(*KEY, "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = chosen.join(texts, [*KEY, "node"]).groupBy(*KEY, "leaf").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                part = batch.slice(at, 256)
                for conv_id, turns in zip(part.column("conv_id").to_pylist(), part.column("turns").to_pylist(), strict=True):
                    text, loss = formatted([(t["role"], t["text"]) for t in turns])
                    back = turns_of(text)
                    learnt = "".join(unescape(text[a:b]) for a, b in loss)
                    told = "".join(f"{r}\n{t}\n" for r, t in back)
                    out.append((conv_id, len(back), hashlib.sha256(told.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text), text, [list(x) for x in loss]))
                names = [c.split()[0] for c in SCHEMA.split(", ")]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return named(rows.select(*KEY, "turns")).mapInArrow(task, SCHEMA)


def chains(turns: DataFrame) -> DataFrame:
    """Messages of conversations given by turn: each row replies to the row before it."""
    rows = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), turns["role"].cast("string").alias("role"), turns["text"].cast("string").alias("text"))
    node = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return rows.withColumn("node", node).select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations_of(chains(rows.unionByName(own))).drop("formatted", "loss_spans")
