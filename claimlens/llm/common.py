"""Shared helpers of the training-data operators: batches, packed word kernels, shared storage.

Everything here runs inside Spark tasks on one bounded block of rows at a time.
Words are found, hashed and joined to n-grams with numpy over the UTF-8 bytes of a
whole block, so no Python loop runs per word.
"""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy block holds; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 20
#: Separators of "words": blank and the control characters tab to carriage return.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: Separators where only ASCII letters, digits and all non-ASCII bytes make words.
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KEEP = np.arange(256, dtype=np.uint8)

_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C17 | 3
_WORD_STEP = np.uint64(0xD6E8FEB86659FD93)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def released(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to: its cleaner waits for the driver's garbage collection, which may be long after their results were written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that text operators read; extra columns, whatever their names, stay behind."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared spark.checkpoint.dir. Where it is unset, a local one on a local master, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/claimlens-{uuid.uuid4().hex}"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows of df from a table in the shared folder, and its path: cuts lineage and outlives executors."""
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    return stored(spark, df, name)[0]


def dropped(spark: SparkSession, *paths: str) -> None:
    """Remove stored tables once all that is made of them is stored too, so that the steps of a job don't add up on the shared disk."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: The most bytes that Spark gathers in one Arrow batch for a task; its own default is 64 MB, kept outside the heap and doubled as it grows.
BATCH_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in this session, unless it says how large they may be."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the column ``text`` of each holds about ``most`` bytes; null texts become empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column("text").fill_null("")
        sizes = np.diff(_offsets(text))
        batch = batch.set_column(batch.schema.get_field_index("text"), "text", text)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            floor = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, floor + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def _offsets(text: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    return np.frombuffer(text.buffers()[1], kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)


def utf8(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an array without nulls, and the n + 1 places where texts begin."""
    off = _offsets(text)
    held = text.buffers()[2]
    data = np.frombuffer(held, np.uint8)[off[0] : off[-1]] if held is not None and off[-1] > off[0] else np.empty(0, np.uint8)
    return data, off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS[0], _POWERS[1]


def _letters(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


class Words:
    """All words of a block: where they start and end, the texts they belong to, and a 64-bit hash of each."""

    def __init__(self, text: pa.Array, separators: np.ndarray = BLANKS, fold: np.ndarray = KEEP):
        self.data, self.off = utf8(text)
        n = len(self.data)
        inside = ~separators[self.data]
        first, last = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        first[self.off] = True
        first[0] = True
        first[1:n] |= ~inside[: n - 1] if n else False
        last[self.off] = True
        last[1:n] |= ~inside[1:] if n else False
        self.start = np.flatnonzero(inside & first[:n])
        self.end = np.flatnonzero(inside & last[1:]) + 1
        #: words[first[i]:first[i + 1]] belong to text i
        self.first = np.searchsorted(self.start, self.off)
        self.fold = fold

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, seed: int = 1) -> np.ndarray:
        power, inverse = _powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_letters(seed)[self.fold[self.data]] * power[: len(self.data)], out=total[1:])
        out = (total[self.end] - total[self.start]) * inverse[self.start]
        return mix(out + (self.end - self.start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.first))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words that start at each word; the last n - 1 words of the block start none."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    m = len(hashes) - n + 1
    out = hashes[:m].copy()
    for k in range(1, n):
        out *= _WORD_STEP
        out += hashes[k : k + m]
    return mix(out)


def gram_starts(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which n-grams lie within one text: their first words, and the texts."""
    text = words.text_of()
    if len(text) < n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :])
    return at, text[at]


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file, as its installed package gives it."""
    import public_tokenizers

    return public_tokenizers.path(name)


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` keys, spread evenly by hash and the same in every run; the only use of a part of a table is to fit models."""
    from pyspark.sql import functions as F

    ids = rows.select(key).where(F.col(key).isNotNull()).distinct()
    return ids.orderBy(F.xxhash64(key), key).limit(most)
