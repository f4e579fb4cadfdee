"""Operator 9, benchmark decontamination: pigeonhole edit matching.

Texts and test items are read as words (ASCII letters folded to lower case, signs
dropped). An item of m words may be hit with up to k = m // PIECE - 1 word edits; split
into k + 1 pieces of PIECE words, one piece is then found unchanged. Piece hashes are
looked up at every word of every text; around each hit the item is verified with Myers'
bit-parallel distance, a word being a letter.

Items are a stated query set. They are taken in blocks of at most ``BLOCK_ITEMS`` items
and ``BLOCK_CHARS`` characters, so what is broadcast has a fixed size; more items mean
more blocks, each a map over the documents. Documents are not shuffled.

Items of fewer than PIECE words have no piece: they are looked up whole, without edits,
as n-grams of their own length at every word of every text.

Defined results: an item without an id is an item, and its hits carry a null; items and texts without words hit nothing; repeated items (same id and text) count
once; repeated documents give a row each; nulls count as empty; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NOT_WORD, Words, blocks, documents, gram_starts, grams, id_and_text

PIECE = 5
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 32 << 20

SCHEMA = "doc_id long, item_id long, distance int, budget int, first_word long, last_word long"


def budget(words: int) -> int:
    return max(words // PIECE - 1, 0)


def myers(pattern: list[int], text: list[int], most: int) -> tuple[int, int]:
    """The least edit distance of the pattern to any stretch of the text, and where the first such stretch ends (exclusive).

    Bit-parallel over the whole pattern; (most + 1, 0) if the distance exceeds ``most``.
    """
    m = len(pattern)
    where: dict[int, int] = defaultdict(int)
    for k, c in enumerate(pattern):
        where[c] |= 1 << k
    top, full = 1 << (m - 1), (1 << m) - 1
    plus, minus, distance, best = full, 0, m, (min(m, most + 1), 0)
    for at, c in enumerate(text, 1):
        eq = where.get(c, 0)
        zero = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        up = minus | (~(zero | plus) & full)
        down = plus & zero
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (~(zero | up) & full)
        minus = up & zero
        if distance < best[0]:
            best = (distance, at)
    return best


def runs(starts: list[int], gap: int) -> Iterator[tuple[int, int]]:
    """The first and last of each run of sorted starts that lie no further apart than gap: they share one window."""
    k = 0
    while k < len(starts):
        first = starts[k]
        while k + 1 < len(starts) and starts[k + 1] <= starts[k] + gap:
            k += 1
        yield first, starts[k]
        k += 1


class Items:
    """A block of test items, with a table of piece hashes."""

    def __init__(self, ids: list[int], texts: list[str]):
        words = Words(pa.array(texts, pa.string()), NOT_WORD, LOWER)
        hashes = words.hashes(9)
        self.ids, self.words, self.short = ids, [], defaultdict(list)
        pieces = []
        for k in range(len(ids)):
            own = hashes[words.first[k] : words.first[k + 1]]
            self.words.append(own.tolist())
            if len(own) >= PIECE:
                starts = np.arange(budget(len(own)) + 1) * PIECE
                pieces += zip(grams(own, PIECE)[starts].tolist(), [k] * len(starts), starts.tolist(), strict=True)
            elif len(own):
                self.short[tuple(own.tolist())].append(k)
        #: Hashes of the short items, by their number of words.
        self.grams = {m: np.unique(np.concatenate([grams(np.array(x, np.uint64), m) for x in self.short if len(x) == m])) for m in {len(x) for x in self.short}}
        pieces.sort()
        self.hash = np.array([p[0] for p in pieces], np.uint64)
        self.item = np.array([p[1] for p in pieces], np.int64)
        self.start = np.array([p[2] for p in pieces], np.int64)
        #: Half of the lookups or more end here.
        self.some = np.zeros(1 << 20, bool)
        self.some[self.hash & np.uint64((1 << 20) - 1)] = True

    def hits(self, text: pa.Array) -> Iterator[tuple[int, int, int, int, int, int]]:
        words = Words(text, NOT_WORD, LOWER)
        hashes = words.hashes(9)
        for m, known in self.grams.items():
            at, of = gram_starts(words, m)
            if not len(at):
                continue
            gram = grams(hashes, m)[at]
            own = np.flatnonzero(np.isin(gram, known))
            order = own[np.lexsort((at[own], gram[own], of[own]))]
            # the first place in each text
            first = np.ones(len(order), bool)
            first[1:] = (of[order[1:]] != of[order[:-1]]) | (gram[order[1:]] != gram[order[:-1]])
            for k in order[first].tolist():
                a, doc = int(at[k]), int(of[k])
                start = a - int(words.first[doc])
                for item in self.short.get(tuple(hashes[a : a + m].tolist()), ()):
                    yield doc, item, 0, 0, start, start + m - 1
        at, of = gram_starts(words, PIECE)
        if not len(at) or not len(self.hash):
            return
        gram = grams(hashes, PIECE)[at]
        maybe = np.flatnonzero(self.some[gram & np.uint64((1 << 20) - 1)])
        lo, hi = np.searchsorted(self.hash, gram[maybe], "left"), np.searchsorted(self.hash, gram[maybe], "right")
        found: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i, a, b in zip(maybe.tolist(), lo.tolist(), hi.tolist(), strict=True):
            for k in range(a, b):
                found[(int(of[i]), int(self.item[k]))].append(int(at[i] - self.start[k]))
        for (doc, item), starts in found.items():
            pattern = self.words[item]
            m, most = len(pattern), budget(len(pattern))
            first, last = int(words.first[doc]), int(words.first[doc + 1])
            best = (most + 1, 0, 0)
            for s, far in runs(sorted(set(starts)), m):
                a, b = max(first, s - most), min(last, far + m + most)
                window = hashes[a:b].tolist()
                distance, end = myers(pattern, window, most)
                if distance < best[0]:
                    _, length = myers(pattern[::-1], window[:end][::-1], most)
                    best = (distance, a + end - length - first, a + end - 1 - first)
            if best[0] <= most:
                yield doc, item, best[0], most, best[1], best[2]


def item_blocks(items: DataFrame) -> Iterator[Items]:
    """The test items in blocks of bounded size."""
    items = items.select(items["item_id"].cast("long").alias("item_id"), F.coalesce(items["text"].cast("string"), F.lit("")).alias("text"))
    items = items.dropDuplicates()
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-n // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        yield Items([r[0] for r in rows], [r[1] for r in rows])


def match(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and item it holds, with the least distance and where; see SCHEMA."""
    out = None
    for block in item_blocks(items):

        def task(batches: Iterator[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            for b in blocks(batches):
                ids = b.column("doc_id").to_pylist()
                found = [(ids[d], block.ids[i], *rest) for d, i, *rest in block.hits(b.column("text"))]
                columns = list(zip(*found, strict=True)) or [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        hits = id_and_text(docs).mapInArrow(task, SCHEMA)
        out = hits if out is None else out.unionByName(hits)
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows that hold none of the items, with all their columns."""
    for block in item_blocks(items):

        def task(batches: Iterator[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = []
                for b in blocks([batch]):
                    ok = np.ones(b.num_rows, bool)
                    ok[[d for d, *_ in block.hits(b.column("text"))]] = False
                    good.append(ok)
                if good:
                    yield batch.filter(pa.array(np.concatenate(good)))

        docs = docs.mapInArrow(task, docs.schema)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
