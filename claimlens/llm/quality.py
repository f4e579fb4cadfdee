"""Operator 3, quality classifier: hashed word n-gram logistic regression, FTRL-proximal updates.

Features are hashed: words, word pairs, the shapes of words (which letter cases,
digits, signs and lengths they mix), shape pairs, and words that repeat the one before.
A feature's value is its share of the text's words, so a score is a sparse dot product
whatever the length, over whole texts.

The model is fitted in one task on at most ``TRAIN_ROWS`` labelled documents (a
documented bound; the rows with the smallest id hashes). Its weights, 2**18 floats, are
the only thing that goes through the driver. Scoring is a map over all documents.

Defined results: null or empty texts get the score of the bias alone; repeated rows give
one row each; an empty table gives none; without labels every score is 0.5; labels, lang,
source, doc_id and other columns are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, KEEP, LOWER, Words, blocks, bounded_sample, documents, grams, id_and_text, mix

BITS = 18
TRAIN_ROWS = 4000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.002, 0.01
CUT = 0.3

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

_CLASS = np.full(256, 16, np.uint8)
_CLASS[BLANKS] = 0
_CLASS[48:58] = 4
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[128:] = 8


def shapes(words: Words) -> np.ndarray:
    """A code of each word: the kinds of bytes in it, its first and last kind, and its length up to 15."""
    if not len(words):
        return np.empty(0, np.uint64)
    kinds = _CLASS[words.data]
    inside = np.bitwise_or.reduceat(kinds, words.start)
    size = np.minimum(words.end - words.start, 15)
    return ((inside.astype(np.uint64) << np.uint64(16)) | (kinds[words.start].astype(np.uint64) << np.uint64(11)) | (kinds[words.end - 1].astype(np.uint64) << np.uint64(5)) | size.astype(np.uint64))


def features(text: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], Words]:
    """Buckets of all features and the texts they are in."""
    words = Words(text, BLANKS, LOWER)
    of, word, shape = words.text_of(), words.hashes(3), shapes(words)
    mask = np.uint64((1 << BITS) - 1)
    buckets, texts = [], []

    def put(codes: np.ndarray, at: np.ndarray, salt: int) -> None:
        buckets.append((mix(codes + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & mask).astype(np.int32))
        texts.append(at)

    put(word, of, 1)
    put(shape, of, 2)
    if len(words) > 1:
        near = of[1:] == of[:-1]
        put(grams(word, 2)[near], of[1:][near], 3)
        put(grams(mix(shape), 2)[near], of[1:][near], 4)
        again = near & (word[1:] == word[:-1])
        put(np.zeros(int(again.sum()), np.uint64), of[1:][again], 5)
    return buckets, texts, words


def vectors(text: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse vectors, one per text: feature buckets and their shares."""
    buckets, texts, words = features(text)
    n = len(text)
    if not len(words):
        return [(np.empty(0, np.int64), np.empty(0))] * n
    key = np.concatenate(texts).astype(np.int64) << BITS | np.concatenate(buckets)
    key, count = np.unique(key, return_counts=True)
    cut = np.searchsorted(key, np.arange(n + 1, dtype=np.int64) << BITS)
    size = np.maximum(np.diff(words.first), 1)
    return [(key[a:b] & ((1 << BITS) - 1), count[a:b] / s) for a, b, s in zip(cut[:-1], cut[1:], size, strict=True)]


class Ftrl:
    """Follow the regularised leader, proximal form, for logistic loss; the last weight is the bias."""

    def __init__(self, bits: int = BITS):
        self.z = np.zeros((1 << bits) + 1)
        self.n = np.zeros((1 << bits) + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        g = (p - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> np.ndarray:
    """Weights (float32, the bias last) learnt from at most ``most`` labelled rows that are not held out."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality"))
    known = known.where(F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.join(F.broadcast(bounded_sample(known, "doc_id", most)), "doc_id")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rows = Ftrl(), []
        for block in blocks(batches):
            rows += zip(block.column("doc_id").to_pylist(), block.column("quality").to_pylist(), vectors(block.column("text")), strict=True)
        ids = np.array([r[0] for r in rows], np.uint64)
        for epoch in range(EPOCHS):
            for k in np.argsort(mix(ids + np.uint64(epoch)), kind="stable"):
                model.learn(*rows[k][2], rows[k][1])
        yield pa.RecordBatch.from_arrays([pa.array([model.weights(slice(None)).astype("<f4").tobytes()], pa.binary())], names=["weights"])

    # at most ``most`` rows reach the one task that learns
    rows = id_and_text(docs).join(F.broadcast(known.limit(most)), "doc_id").dropDuplicates(["doc_id"])
    learnt = rows.repartition(1).mapInArrow(task, "weights binary").first()  # no row at all where no labelled row is there
    return np.frombuffer(learnt[0], "<f4") if learnt else np.zeros((1 << BITS) + 1, "<f4")


def probabilities(text: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Scores of a block of texts: sparse dot products, all at once."""
    buckets, texts, words = features(text)
    total = np.zeros(len(text))
    for b, t in zip(buckets, texts, strict=True):
        total += np.bincount(t, weights[b].astype(float), minlength=len(text))
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(np.diff(words.first), 1) + float(weights[-1]), -30, 30)))


def score(docs: DataFrame, weights: np.ndarray, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score (probability of label 1), predicted."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            p = probabilities(block.column("text"), weights)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(p), pa.array((p >= cut).astype(np.int32))], names=["doc_id", "score", "predicted"])

    found = id_and_text(docs).mapInArrow(task, "doc_id long, score double, predicted int")
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, weights: np.ndarray, cut: float = CUT) -> DataFrame:
    """The rows whose score reaches the cut, with all their columns."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [probabilities(b.column("text"), weights) >= cut for b in blocks([batch])]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(task, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
