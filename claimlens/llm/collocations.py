"""Operator 13, phrase collocation mining: direct-address tiling of pair counts.

Words are told apart by a 64-bit hash of (lang, word), which is checked to be without
collisions. Words that are frequent enough are ranked by frequency; a phrase of m words is a
pair: the rank of its first m - 1 words (a frequent phrase, ranked in its turn) and the rank
of its last word. So each length is the same counting problem, on pairs that were re-ranked.

A task maps its texts to pairs of ranks. The grid of ranks is cut into tiles of TILE x TILE
cells: tiles with many pairs are counted with one dense bincount, all other pairs as sorted
coordinates with counts (COO). Both are packed, dealt by tile and summed there. As tiles are
summed in tasks first, a pair that a third of all texts repeat arrives once a task.

At most RANKED words and RANKED phrases of a length have ranks, so what is broadcast has a
fixed size. Those beyond are exact too: they are kept as tuples of word hashes, and a bitmap
of fixed size tells which of them can be frequent at all (it may mark more, never fewer).
A phrase can only be frequent if both phrases that it extends are; all others aren't counted.

Defined results: null text has no words; null lang is ``und``; repeated rows count each; an
empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, Words, blocks, bounded_batches, documents, dropped, mix, stored
from .substrings import opened, squeezed

#: Bytes that end a piece, and bytes that end a word.
PIECES = np.zeros(256, bool)
PIECES[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAPS = PIECES.copy()
GAPS[[0x20, 0x09]] = True

LEAST, LONGEST, TOP = 10, 3, 2000
#: The most ranks of a length: what is broadcast for it is 20 bytes a rank.
RANKED = 1 << 19
#: Cells of a tile's side; tiles of the HEAD first bands with a pair for each 16 cells are counted dense.
TILE, HEAD = 1024, 16
#: Pairs, and distinct words, that a task holds before it packs them.
PAIRS, TYPES = 1 << 21, 1 << 19
#: Words of the corpus for each part that pairs are dealt to.
PART_WORDS = 4_000_000
BITS = 26
SALTS = 16
TEXT_BYTES = 2 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def block_words(block: pa.RecordBatch, seed: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of a block, a hash of each with its lang, and whether each stands in one piece with the next."""
    words = Words(block.column("text"), GAPS, LOWER)
    langs = block.column("lang").dictionary_encode()
    own = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs.dictionary.to_pylist()] or [0], np.uint64)
    text = words.text_of()
    keys = mix(words.hashes(11 + seed) ^ own[np.asarray(langs.indices)[text]])
    ends = np.concatenate([[0], np.cumsum(PIECES[words.data])])
    joined = np.zeros(len(words), bool)
    if len(words):
        joined[:-1] = (text[1:] == text[:-1]) & (ends[words.start[1:]] == ends[words.end[:-1]])
    return words, keys, joined


def spelled(words: Words, at: np.ndarray) -> pa.Array:
    """The folded texts of some words."""
    size = words.end[at] - words.start[at]
    off = np.concatenate([[0], np.cumsum(size)])
    data = LOWER[words.data[np.repeat(words.start[at] - off[:-1], size) + np.arange(off[-1])]]
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data.tobytes()))


def texts_of(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(docs["text"].cast("string").alias("text"), F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"))


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """hash, lang, word and f of every word."""

    def packed(held: list[tuple]) -> pa.RecordBatch:
        keys, at, of = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True)
        n = np.bincount(of, np.concatenate([h[1] for h in held]), len(keys)).astype(np.int64)
        take = pa.array(at)
        columns = [pa.array(keys.view(np.int64)), pa.concat_arrays([h[2] for h in held]).take(take), pa.concat_arrays([h[3] for h in held]).take(take), pa.array(n)]
        return pa.RecordBatch.from_arrays(columns, names=["hash", "lang", "word", "n"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for block in blocks(batches, TEXT_BYTES):
            words, keys, _ = block_words(block, seed)
            if not len(words):
                continue
            own, at, n = np.unique(keys, return_index=True, return_counts=True)
            of = np.searchsorted(words.first, at, "right") - 1
            held.append((own, n, block.column("lang").take(pa.array(of)).cast(pa.string()), spelled(words, at)))
            size += len(own)
            if size > TYPES:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    rows = texts_of(docs).mapInArrow(task, "hash long, lang string, word string, n long")
    return rows.repartition("hash").groupBy("hash", "lang", "word").agg(F.sum("n").alias("f"))


@dataclass
class Level:
    """Frequent phrases of one length: ranks by frequency, and a bitmap for those without a rank.

    codes: what ranks are looked up by (a word's hash, or the pair of ranks), sorted; ranks: of
    each code; hashes: the words' hashes of each rank; bits: a bitmap over phrase keys, or None.
    """

    codes: np.ndarray
    ranks: np.ndarray
    hashes: np.ndarray
    bits: np.ndarray | None

    def rank(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.full(len(codes), -1, np.int32)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.ranks[at], -1)

    def beyond(self, keys: np.ndarray) -> np.ndarray:
        """Whether a phrase without a rank can be frequent."""
        if self.bits is None:
            return np.zeros(len(keys), bool)
        at = keys >> np.uint64(64 - BITS)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def longer(keys: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Keys of phrases that go on by one word."""
    return mix(keys * _STEP + last)


def extended(words: np.ndarray, joined: np.ndarray, levels: list[Level]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (left rank, right rank) of phrases one word longer than the levels, and the hashes of those without ranks."""
    n, m = len(words), len(levels) + 1
    if n < m:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, m), np.uint64)
    one = levels[0].rank(words)
    rank, keys, whole = one, words, np.ones(n, bool)
    often = (rank >= 0) | levels[0].beyond(keys)
    for m, level in enumerate(levels[1:], 2):
        whole = whole[: n - m + 1] & joined[m - 2 : n - 1]
        left, right = rank[: len(whole)], one[m - 1 :]
        keys = longer(keys[: len(whole)], words[m - 1 :])
        known = whole & (left >= 0) & (right >= 0)
        rank = np.full(len(whole), -1, np.int32)
        rank[known] = level.rank(left[known].astype(np.int64) << 32 | right[known])
        often = whole & ((rank >= 0) | level.beyond(keys))
    m = len(levels) + 1
    at = np.flatnonzero(often[: n - m + 1] & often[1 : n - m + 2] & joined[m - 2 : n - 1])
    left, right = rank[at].astype(np.int64), one[at + m - 1].astype(np.int64)
    both = (left >= 0) & (right >= 0)
    rest = at[~both]
    return left[both], right[both], np.stack([words[rest + k] for k in range(m)], 1)


def tiles(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes (left << 32 | right) and their counts: dense tiles by bincount, the rest by sorting."""
    left, right = codes >> 32, codes & 0xFFFFFFFF
    head = np.flatnonzero((left < HEAD * TILE) & (right < HEAD * TILE))
    tile = (left[head] // TILE * HEAD + right[head] // TILE).astype(np.uint8)
    dense = np.flatnonzero(np.bincount(tile, minlength=HEAD * HEAD) >= TILE * TILE // 16)
    found, counts = [], []
    sparse = np.ones(len(codes), bool)
    for t in dense.tolist():
        own = head[tile == t]
        sparse[own] = False
        cells = np.bincount((left[own] % TILE) * TILE + right[own] % TILE, minlength=TILE * TILE)
        at = np.flatnonzero(cells)
        found.append((t // HEAD * TILE + at // TILE) << 32 | (t % HEAD * TILE + at % TILE))
        counts.append(cells[at])
    own, n = np.unique(codes[sparse], return_counts=True)
    keys, n = np.concatenate([*found, own]), np.concatenate([*counts, n])
    order = np.argsort(keys, kind="stable")
    return keys[order], n[order]


def summed(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a table of words, with their counts added."""
    order = np.lexsort(rows.T[::-1])
    rows, counts = rows[order], counts[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(1)
    at = np.flatnonzero(new)
    return rows[at], np.add.reduceat(counts, at) if len(at) else counts


PACKED = "part int, wide int, codes binary, counts binary"


def packed_pairs(batches: Iterator[pa.RecordBatch], levels: list[Level], parts: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Pairs counted in this task, packed by part; rows without ranks (``wide`` 1) beside them."""
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())

    def out(pairs: list[np.ndarray], rest: list[np.ndarray]) -> pa.RecordBatch:
        rows = []
        codes, counts = tiles(np.concatenate(pairs) if pairs else np.empty(0, np.int64))
        tile = (codes >> 32) // TILE << 32 | (codes & 0xFFFFFFFF) // TILE
        for part, (c, n) in dealt((mix(tile.astype(np.uint64)) % np.uint64(parts)).astype(np.int32), codes, counts):
            rows.append((part, 0, squeezed(np.diff(c, prepend=0).astype("<i8")), squeezed(n.astype("<i8"))))
        if rest:
            wide = np.concatenate(rest)
            wide, counts = summed(wide, np.ones(len(wide), np.int64))
            for part, (c, n) in dealt((mix(wide[:, 0] ^ mix(wide[:, -1])) % np.uint64(parts)).astype(np.int32), wide, counts):
                rows.append((part, 1, c.tobytes(), squeezed(n.astype("<i8"))))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["part", "wide", "codes", "counts"])

    pairs, rest, size = [], [], 0
    for block in blocks(batches, TEXT_BYTES):
        _, words, joined = block_words(block, seed)
        left, right, wide = extended(words, joined, levels)
        pairs.append(left << 32 | right)
        if len(wide):
            rest.append(wide)
        size += len(left) + len(wide)
        if size > PAIRS:
            yield out(pairs, rest)
            pairs, rest, size = [], [], 0
    if size:
        yield out(pairs, rest)


def dealt(part: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """Rows of each part, in the order they have."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for own in np.split(order, cuts) if len(order) else ():
        yield int(part[own[0]]), tuple(c[own] for c in columns)


def frequent(batches: Iterator[pa.RecordBatch], levels: list[Level], least: int) -> Iterator[pa.RecordBatch]:
    """Sum the packed pairs of each part; those found ``least`` times at least, by their words' hashes."""
    width = len(levels) + 1

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        keys, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, at, np.concatenate([h[1] for h in held]))
        return [(keys, total)]

    def out(narrow: list[tuple], wide: list[tuple]) -> pa.RecordBatch:
        codes, n = merged(narrow)[0] if narrow else (np.empty(0, np.int64), np.empty(0, np.int64))
        codes, n = codes[n >= least], n[n >= least]
        hashes = np.concatenate([levels[-1].hashes[codes >> 32], levels[0].hashes[codes & 0xFFFFFFFF]], 1)
        rest, m = summed(np.concatenate([h[0] for h in wide]), np.concatenate([h[1] for h in wide])) if wide else (np.empty((0, width), np.uint64), np.empty(0, np.int64))
        rest, m = rest[m >= least], m[m >= least]
        words = np.concatenate([hashes, rest])
        keys = functools.reduce(longer, words.T[1:], words[:, 0])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, words.size + 1, width, dtype=np.int32)), pa.array(words.ravel().view(np.int64)))
        code = pa.array(np.concatenate([codes, np.full(len(rest), -1)]), pa.int64())
        return pa.RecordBatch.from_arrays([lists, pa.array(keys.view(np.int64)), code, pa.array(np.concatenate([n, m]), pa.int64())], names=["words", "key", "code", "f"])

    part, narrow, wide, size = None, [], [], 0
    for batch in batches:
        for own, kind, codes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != part:
                if part is not None:
                    yield out(narrow, wide)
                part, narrow, wide, size = own, [], [], 0
            n = opened(counts, "<i8")
            if kind:
                wide.append((np.frombuffer(codes, np.uint64).reshape(-1, width), n))
            else:
                narrow.append((np.cumsum(opened(codes, "<i8")), n))
            size += len(n)
            if size > PAIRS:  # what repeats is added up on the way
                narrow = merged(narrow) if narrow else []
                wide = [summed(np.concatenate([h[0] for h in wide]), np.concatenate([h[1] for h in wide]))] if wide else []
                size = 0
    if part is not None:
        yield out(narrow, wide)


def levelled(rows: DataFrame, before: list[Level], ranked: int) -> Level:
    """Rank the phrases of a length by frequency, at most ``ranked`` of them; the others set bits. rows: code (-1: none), key, f."""
    spark = rows.sparkSession
    # frequencies in steps of a sixteenth of a power of two: the last step whose phrases all get ranks
    steps = rows.where("code <> -1").groupBy(F.floor(F.log2("f") * 16).cast("int").alias("step")).agg(F.count("*").alias("n")).collect()
    least, held = 1 << 20, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        held += r["n"]
        if held > ranked:
            break
        least = r["step"]
    rises = (F.col("code") != -1) & (F.floor(F.log2("f") * 16) >= least)
    top = rows.where(rises).select("code", "f").toArrow()
    codes, f = np.asarray(top["code"]), np.asarray(top["f"])
    order = np.lexsort((codes, -f))
    if before:
        hashes = np.concatenate([before[-1].hashes[codes[order] >> 32], before[0].hashes[codes[order] & 0xFFFFFFFF]], 1)
    else:
        codes = codes.view(np.uint64)
        hashes = codes[order].reshape(-1, 1)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    sort = np.argsort(codes)
    at = F.shiftrightunsigned("key", 64 - BITS) + 1
    found = rows.where(~rises).groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    bits = None
    for r in found.toLocalIterator():  # at most 2 ** BITS / 32768 rows of 4 kB
        bits = np.zeros(1 << BITS - 3, np.uint8) if bits is None else bits
        bits[(r["bucket"] - 1) * 4096 :][:4096] = np.frombuffer(r["bits"], np.uint8)
    return Level(codes[sort], rank[sort], hashes, bits)


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, ranked: int = RANKED) -> tuple[DataFrame, list[DataFrame], list[str]]:
    """All words (hash, lang, word, f), the frequent phrases of 2 to ``longest`` words (words, f), and where they are stored."""
    spark = docs.sparkSession
    for seed in range(8):
        words, at = stored(spark, word_counts(docs, seed), "words")
        if words.groupBy("hash").count().where("count > 1").isEmpty():
            break
        dropped(spark, at)
    else:
        raise ValueError("no seed gives all words hashes of their own")
    paths, tables = [at], []
    total = words.agg(F.sum("f")).first()[0] or 0
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART_WORDS)
    rows, levels = words.where(F.col("f") >= least).select(F.col("hash").alias("code"), F.col("hash").alias("key"), "f"), []
    # a word's hash may be any number, so -1 stands for no code of pairs only
    rows = rows.withColumn("code", F.when(F.col("code") != -1, F.col("code")).otherwise(F.lit(-1)))
    for _ in range(longest - 1):
        levels.append(levelled(rows, levels, ranked))
        known = spark.sparkContext.broadcast(list(levels))
        packed = texts_of(docs).mapInArrow(functools.partial(_pack, known, parts, seed), PACKED)
        spread = packed.repartition(min(parts, 20_000), "part").sortWithinPartitions("part")
        rows, at = stored(spark, spread.mapInArrow(functools.partial(_sum, known, least), "words array<long>, key long, code long, f long"), "phrases")
        paths.append(at)
        tables.append(rows.select("words", "f"))
    return words, tables, paths


def _pack(known, parts: int, seed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return packed_pairs(batches, known.value, parts, seed)


def _sum(known, least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return frequent(batches, known.value, least)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, ranked: int = RANKED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's best phrases; see the module's text."""
    words, tables, _ = phrases(docs, least, longest, ranked)
    known = words.where(F.col("f") >= least)
    by_length = [known.select(F.array("hash").alias("words"), "f"), *tables]
    scored = []
    for m, table in enumerate(tables, 2):
        rows = table.withColumnRenamed("f", "a")
        best = []
        for k in range(1, m):  # cut after k words
            rows = rows.withColumns({"first": F.slice("words", 1, k), "rest": F.slice("words", k + 1, m - k)})
            rows = rows.join(by_length[k - 1].select(F.col("words").alias("first"), F.col("f").alias(f"l{k}")), "first").drop("first")
            rows = rows.join(by_length[m - k - 1].select(F.col("words").alias("rest"), F.col("f").alias(f"r{k}")), "rest").drop("rest")
            big = lambda c: F.col(c).cast("decimal(19,0)")
            rows = rows.withColumns({f"_up{k}": (big("a") * big("a")).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)"), f"_down{k}": big(f"l{k}") * big(f"r{k}")})
            best.append(F.struct(F.expr(f"_up{k} div _down{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        rows = rows.withColumn("cut", best[0] if m == 2 else F.least(*best))
        longer_ones = [t.select(F.explode(F.array(*(F.slice("words", s, m) for s in range(1, n - m + 2)))).alias("words"), "f") for n, t in enumerate(tables, 2) if n > m]
        if longer_ones:
            inside = functools.reduce(DataFrame.unionByName, longer_ones).groupBy("words").agg(F.max("f").alias("inside"))
            rows = rows.join(inside, "words", "left").where(F.col("inside").isNull() | (F.col("inside") * 2 < F.col("a")))
        for k in range(m):
            rows = rows.withColumn("hash", F.col("words")[k]).join(known.select("hash", F.col("word").alias(f"w{k}"), F.col("lang").alias(f"lang{k}")), "hash").drop("hash")
        scored.append(rows.select(F.col("lang0").alias("lang"), F.concat_ws(" ", *(f"w{k}" for k in range(m))).alias("phrase"), "a", "cut.l", "cut.r", "cut.score"))
    rows = functools.reduce(DataFrame.unionByName, scored)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # one lang may hold most phrases: the best of each of SALTS parts first, so that few rows meet
    parts = Window.partitionBy("lang", "salt").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= top)
    best = rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.join(words.groupBy("lang").agg(F.sum("f").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


#: The same in DuckDB SQL.
SQL = r"""
with t as (select row_number() over () as id, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
p as (select lang, row_number() over () as id, piece from (select lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) as piece from t)),
w as (select * from (select lang, id, unnest(ws) as w, generate_subscripts(ws, 1) as k from (select lang, id, string_split_regex(piece, '[\x20\x09]+') as ws from p)) where w <> ''),
s as (select lang, w as w1, lead(w) over (partition by id order by k) as w2, lead(w, 2) over (partition by id order by k) as w3 from w),
n as (select lang, count(*) as n from s group by 1),
f1 as (select lang, w1, count(*) as f from s group by all),
f2 as (select lang, w1, w2, count(*) as f from s where w2 is not null group by all),
f3 as (select lang, w1, w2, w3, count(*) as f from s where w3 is not null group by all having count(*) >= 10),
c as (select f2.lang, concat(f2.w1, ' ', f2.w2) as phrase, f2.f as a, x.f as l, y.f as r, cast(1000000::hugeint * f2.f * f2.f // (x.f::hugeint * y.f) as bigint) as score
      from f2 join f1 x on x.lang = f2.lang and x.w1 = f2.w1 join f1 y on y.lang = f2.lang and y.w1 = f2.w2
      where f2.f >= 10 and not exists (select 1 from f3 where f3.lang = f2.lang and f3.w1 = f2.w1 and f3.w2 = f2.w2 and 100 * f3.f >= 50 * f2.f)
        and not exists (select 1 from f3 where f3.lang = f2.lang and f3.w2 = f2.w1 and f3.w3 = f2.w2 and 100 * f3.f >= 50 * f2.f)
      union all
      select lang, phrase, a, case when s1 <= s2 then l1 else l2 end, case when s1 <= s2 then r1 else r2 end, least(s1, s2) from (
        select f3.lang, concat(f3.w1, ' ', f3.w2, ' ', f3.w3) as phrase, f3.f as a, a1.f as l1, b1.f as r1, a2.f as l2, b2.f as r2,
               cast(1000000::hugeint * f3.f * f3.f // (a1.f::hugeint * b1.f) as bigint) as s1, cast(1000000::hugeint * f3.f * f3.f // (a2.f::hugeint * b2.f) as bigint) as s2
        from f3 join f1 a1 on a1.lang = f3.lang and a1.w1 = f3.w1 join f2 b1 on b1.lang = f3.lang and b1.w1 = f3.w2 and b1.w2 = f3.w3
             join f2 a2 on a2.lang = f3.lang and a2.w1 = f3.w1 and a2.w2 = f3.w2 join f1 b2 on b2.lang = f3.lang and b2.w1 = f3.w3)),
q as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from c)
select lang, rank, phrase, a, l, r, n, score from q join n using (lang) where rank <= 2000
"""
