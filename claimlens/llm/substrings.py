"""Operator 5, substring dedup: De Bruijn compaction of repeated word windows.

A window of K consecutive words is an edge of the De Bruijn graph of word k-mers. Edges
are hashed in tasks over blocks of whole texts and dealt by their minimiser, the least of
the hashes of their SEED-grams, so consecutive edges of a text travel together. Of the
edges of a block that are alike, the one of the smallest document asks; those of
other documents are repeats already. So a passage that a third of all rows share asks once
a block, and the groups that meet in one task grow with blocks, not with rows. Its later
places in the asking document go along as an inner list and share its owner.

Where all that ask meet, each edge's owner is the smallest document that has it.
Repeats that follow each other are nonbranching paths; they are compacted into spans where
they are found, and spans of a document are joined with its text, glued where they touch,
and their words removed. A span carries the source coordinates of its owner, which is
how ``verified`` compares both texts word by word.

Windows are judged on the input: a window is a repeat if it also starts in a document with
a smaller doc_id. Edges are told apart by 64 + 16 bits of two independent hashes.

Defined results: null counts as no words; a text shorter than K words keeps them all;
rows with the same doc_id are one document for the rule, each gives its row and loses only
words of its own text; a row without doc_id is compared with none and keeps all its words; an
empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, Words, blocks, documents, gram_starts, grams, id_and_text, mix
from .ngram_join import marked

K = 13
SEED = 4
#: Bytes of text whose edges are packed together: the larger, the more repeats are found before the shuffle.
EDGE_BYTES = 2 << 20
#: Parts that edges are dealt to, for each shuffle partition.
DEALT = 2
_WORD = re.compile("[^\x20\x09-\x0d]+")

#: Edges of one block and one part, packed: documents and rows, 8-byte hashes, 2-byte checks, and words where
#: they start; then how many later places each has in its row, and these places.
PACKED = "part int, ids binary, rows binary, counts binary, hashes binary, checks binary, places binary, more binary, inner binary"
#: ``row`` tells rows that share a doc_id apart: a hash of the text, 0 where no other row has that doc_id.
SPANS = "doc_id long, row long, start int, length int, owner long, owner_row long, owner_start int"


def minimisers(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The least SEED-gram hash within each K-word window."""
    seeds = mix(grams(words, SEED) ^ np.uint64(0x5851F42D4C957F2D))
    width, done = K - SEED + 1, 1
    while done < width:
        step = min(done, width - done)
        seeds = np.minimum(seeds[: len(seeds) - step], seeds[step:])
        done += step
    return seeds[at]


def runs(doc: np.ndarray, row: np.ndarray, at: np.ndarray, owner: np.ndarray, owner_row: np.ndarray, owner_at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Compact repeated edges, ordered by row and place, into spans: paths along which owner and place step together."""
    if not len(doc):
        return (np.empty(0, np.int64),) * 7
    new = np.ones(len(doc), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (owner_at[1:] != owner_at[:-1] + 1)
    for same in (doc, row, owner, owner_row):
        new[1:] |= same[1:] != same[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(doc)))
    return doc[first], row[first], at[first], size + K - 1, owner[first], owner_row[first], owner_at[first]


def spans_batch(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in SPANS.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, {"long": pa.int64(), "int": pa.int32()}[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def squeezed(x: np.ndarray) -> bytes:
    """Steps between numbers, byte planes apart, deflated: what edges carry beside their hashes is mostly small steps."""
    return zlib.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 1)


def opened(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def after(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ``sizes`` numbers that follow each number of ``at``, one list after the other."""
    return np.repeat(at + 1 - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def edges(batches: Iterator[pa.RecordBatch], dealt: int) -> Iterator[pa.RecordBatch]:
    """Pack the edges that ask; repeats within the block go along as parts of their own (part -1: spans)."""
    names = [c.split()[0] for c in PACKED.split(", ")]
    kinds = [pa.int32()] + [pa.binary()] * 8
    for block in blocks(batches, EDGE_BYTES):
        words = Words(block.column("text"), BLANKS)
        at, of = gram_starts(words, K)
        if not len(at):
            continue
        one = words.hashes(5)
        hashes = grams(one, K)[at]
        checks = (grams(words.hashes(6), K)[at] >> np.uint64(48)).astype("<u2")
        part = (minimisers(one, at) % np.uint64(dealt)).astype(np.int64)
        doc, row = np.asarray(block.column("doc_id"))[of], np.asarray(block.column("row"))[of]
        place = at - words.first[of]
        # of edges alike, the first of each row of the smallest document asks
        order = np.lexsort((place, row, doc, checks, hashes)) if np.any(doc[1:] < doc[:-1]) else np.lexsort((checks, hashes))
        same = np.zeros(len(order), bool)
        same[1:] = (hashes[order[1:]] == hashes[order[:-1]]) & (checks[order[1:]] == checks[order[:-1]])
        lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        owner, owner_row, owner_at = np.empty_like(doc), np.empty_like(row), np.empty_like(place)
        owner[order], owner_row[order], owner_at[order] = doc[lead], row[lead], place[lead]
        own = doc[order] == doc[lead]
        first = ~same
        first[1:] |= own[1:] & (row[order[1:]] != row[order[:-1]])
        asks = np.zeros(len(order), bool)
        asks[order[first]] = True
        # its later places in that row follow it in this order
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        more = np.zeros(len(order), np.int64)
        np.add.at(more, order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))][own & ~first], 1)
        repeat = np.flatnonzero(doc > owner)
        if len(repeat):
            repeat = repeat[np.lexsort((place[repeat], row[repeat], doc[repeat]))]
            cols = runs(*(c[repeat] for c in (doc, row, place, owner, owner_row, owner_at)))
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *(pa.array([c.astype("<i8").tobytes()], pa.binary()) for c in cols), pa.array([b""], pa.binary())], names=names)
        keep = np.flatnonzero(asks)
        keep = keep[np.argsort(part[keep], kind="stable")]
        cut = np.flatnonzero(np.diff(part[keep])) + 1
        rows: list[list] = [[] for _ in names]
        for g in np.split(keep, cut):
            d, r = doc[g], row[g]
            turn = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (r[1:] != r[:-1])]))
            inner = place[order[after(rank[g], more[g])]]
            for column, x in zip(rows, (int(part[g[0]]), squeezed(np.diff(d[turn], prepend=0).astype("<i8")), squeezed(r[turn].astype("<i8")), squeezed(np.diff(np.append(turn, len(g))).astype("<u4")), hashes[g].astype("<u8").tobytes(), checks[g].tobytes(), squeezed(np.diff(place[g], prepend=0).astype("<i4")), squeezed(more[g].astype("<u4")), squeezed(np.diff(inner, prepend=0).astype("<i4"))), strict=True):
                column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=names)


def owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Give the spans whose edges a smaller document has, part after part."""
    part, blobs = None, []
    for batch in batches:
        for next_part, *own in zip(*(batch.column(k).to_pylist() for k in range(9)), strict=True):
            if next_part < 0:
                yield spans_batch(tuple(np.frombuffer(b, "<i8") for b in own[:7]))
                continue
            if next_part != part:
                yield owned(blobs)
                part, blobs = next_part, []
            blobs.append(own)
    yield owned(blobs)


def owned(blobs: list[list[bytes]]) -> pa.RecordBatch:
    """Spans of the repeats in one part."""
    if not blobs:
        return spans_batch(runs(*(np.empty(0, np.int64),) * 6))
    counts = [opened(b[2], "<u4") for b in blobs]
    doc = np.concatenate([np.repeat(np.cumsum(opened(b[0], "<i8")), n) for b, n in zip(blobs, counts, strict=True)])
    row = np.concatenate([np.repeat(opened(b[1], "<i8"), n) for b, n in zip(blobs, counts, strict=True)])
    hashes = np.concatenate([np.frombuffer(b[3], "<u8") for b in blobs])
    checks = np.concatenate([np.frombuffer(b[4], "<u2") for b in blobs])
    place = np.concatenate([np.cumsum(opened(b[5], "<i4")) for b in blobs])
    more = np.concatenate([opened(b[6], "<u4") for b in blobs]).astype(np.int64)
    inner = np.concatenate([np.cumsum(opened(b[7], "<i4")) for b in blobs])
    order = np.lexsort((place, row, doc, checks, hashes))
    first, more = (np.cumsum(more) - more)[order], more[order]
    doc, row, place, hashes, checks = doc[order], row[order], place[order], hashes[order], checks[order]
    same = np.zeros(len(doc), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (checks[1:] == checks[:-1])
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(doc))))
    repeat = np.flatnonzero(doc > doc[lead])
    at = np.concatenate([place[repeat], inner[after(first[repeat] - 1, more[repeat])]])
    repeat = np.concatenate([repeat, np.repeat(repeat, more[repeat])])
    order = np.lexsort((at, row[repeat], doc[repeat]))
    repeat, at = repeat[order], at[order]
    lead = lead[repeat]
    return spans_batch(runs(doc[repeat], row[repeat], at, doc[lead], row[lead], place[lead]))


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, row and text; see SPANS for ``row``. Only ids are shuffled."""
    rows = id_and_text(docs)
    repeated = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    may = marked(rows, repeated, "doc_id")
    return may.select("doc_id", F.when(F.col("may"), F.xxhash64("text")).otherwise(F.lit(0)).cast("long").alias("row"), "text")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Spans of words that repeat a document with a smaller doc_id, with the owner's coordinates; see SPANS."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = rows_of(docs).where("doc_id is not null").mapInArrow(lambda batches: edges(batches, DEALT * parts), PACKED)
    # spans found within a block have no part to meet in: they are dealt by what they hold
    key = F.when(F.col("part") >= 0, F.col("part")).otherwise(F.xxhash64("ids"))
    return packed.repartition(parts, key).sortWithinPartitions("part").mapInArrow(owners, SPANS)


def remove(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Each document without the words of its spans: doc_id, n_words, n_removed, kept_sha256, kept."""
    own = spans.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    joined = rows_of(docs).join(own, ["doc_id", "row"], "left").select("doc_id", "text", F.transform("spans", lambda s: s["start"]).alias("starts"), F.transform("spans", lambda s: s["length"]).alias("lengths"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            rows = []
            for doc_id, text, starts, lengths in zip(*(block.column(c).to_pylist() for c in ("doc_id", "text", "starts", "lengths")), strict=True):
                words = _WORD.findall(text)
                n, out = len(words), 0
                if starts:
                    reach, kept = 0, []
                    for a, size in sorted(zip(starts, lengths, strict=True)):  # spans that touch or overlap are glued
                        kept += words[reach:a]
                        out += max(0, a + size - max(a, reach))
                        reach = max(reach, a + size)
                    words = kept + words[reach:]
                text = " ".join(words)
                rows.append((doc_id, n, out, hashlib.sha256(text.encode()).hexdigest(), text))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return joined.mapInArrow(task, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def verified(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans with a column ``same``: whether the words at both coordinates are equal. A check; joins texts twice."""
    words = rows_of(docs).dropDuplicates(["doc_id", "row"]).select("doc_id", "row", F.filter(F.split(F.coalesce("text", F.lit("")), "[ \t-\r]+"), lambda w: w != "").alias("words"))
    mine = spans.join(words, ["doc_id", "row"]).withColumn("mine", F.slice("words", F.col("start") + 1, F.col("length"))).drop("words")
    theirs = words.select(F.col("doc_id").alias("owner"), F.col("row").alias("owner_row"), "words")
    return mine.join(theirs, ["owner", "owner_row"]).withColumn("same", F.col("mine") == F.slice("words", F.col("owner_start") + 1, F.col("length"))).drop("words", "mine")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return remove(docs, repeated_spans(docs)).drop("kept")
