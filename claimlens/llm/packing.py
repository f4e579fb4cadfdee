"""Operator 1, packing: vector bin packing by the dot-product heuristic.

Every item has three sizes: tokens, segments (1) and loss-bearing tokens. An open
sequence has a rest of each. Among the waiting items the one whose sizes have the
largest dot product with the rests, both as shares of the limits, goes in next; where
its tokens or loss-bearing tokens exceed the rest it is cut there, so a sequence ends
full. What is left at the end of a task is laid out in sequences whose lengths are
powers of two, which need no padding either.

Each task packs its own input rows, holding at most ``WAITING`` items and one block of
texts; nothing is shuffled, and a lost task is packed again from its input. A text
longer than a sequence first gives whole sequences of its own.

Defined results: a null or empty text is one end token; repeated rows are packed once
each; an empty table gives no row; all tokens bear loss, or the last ones of a text, as
many as the column that is named for it says (null: all; its end token counts as one of them);
other columns are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Merges, byte_letters
from .common import blocks, documents, tokenizer_path

#: Tokens, segments and loss-bearing tokens that a sequence may hold.
LIMITS = (4096, 512, 4096)
WAITING = 256
END_ID = 2
#: Chunks whose ids a worker keeps, and how long they may be.
CACHED = 800_000
LONG = 64
#: Fixed value: what marks a token that ends a word.
WORD_END = "</w>"

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class WordIds(dict):
    """Ids of texts for a tokenizer that drops white space: a memory of blank-separated chunks, each learnt when first asked.

    A chunk's words are merged by the public byte-pair encoder, whose ranks are the
    tokenizer's merges and whose byte 255 stands for a word's end. As every token is its
    own encoding (``Merges.own``), both merge alike: parts that join to a token can only
    be the two that its merge names. Chunks with rare characters, where NFC, lower case or
    white space need more than a look at Latin letters, go through the tokenizer itself.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self[""] = b""
        self.tokenizer = Tokenizer.from_file(path)
        merges = Merges(path)
        byte = {letter: b for b, letter in byte_letters().items()}
        ranks = {}
        for token, k in merges.vocab.items():
            if merges.own[k]:
                word = token.removesuffix(WORD_END)
                ranks[bytes(map(byte.__getitem__, word)) + b"\xff" * (word != token)] = k
        # ids serve as ranks: a last byte must take the end in before merges, and these must be in the order of their ids
        made = np.array([merges.vocab[t] for t in merges.vocab if merges.rank[merges.vocab[t]] >= 0])
        made = made[np.argsort(merges.rank[made])]
        ends = [k for t, k in ranks.items() if len(t) == 2 and t[1] == 255]
        if (np.diff(made) <= 0).any() or max(ends) >= made[0]:
            raise ValueError("the tokenizer's ids aren't in the order of its merges")
        ranks[b"\xff"] = max(ranks.values()) + 1
        self.piece = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        #: The words of the tokenizer.
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.latin = regex.compile("[!-~\xa1-\u024f]+").fullmatch

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > CACHED:
            self.clear()
        plain = chunk.isascii() and chunk.isprintable()
        if (plain or self.latin(chunk)) and "<|" not in chunk:
            low = chunk.lower() if plain else "".join(map(str.lower, chunk))
            if low.isalpha():
                ids = self.piece(low.encode() + b"\xff")
            else:
                ids = [i for word in self.words(low) for i in self.piece(word.encode() + b"\xff")]
            held = array("I", ids).tobytes()
        else:
            held = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if len(chunk) <= LONG:
            self[chunk] = held
        return held

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids. No token spans a blank or a line end."""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One per worker, so what a task has learnt serves the next."""
    return WordIds(path)


class Packer:
    """Places items into sequences; gives (item, start, length, loss, sequence, offset) for each piece."""

    def __init__(self, limits: tuple[int, int, int] = LIMITS, waiting: int = WAITING):
        self.limits, self.most = np.array(limits, float), waiting
        self.items: list = []
        self.size = np.zeros((waiting, 3))  # of the waiting items, as shares of the limits, in their order
        self.pieces: list = []  # of the open sequence
        self.rest = self.limits.copy()
        self.sequence = 0
        self.done: list = []

    def add(self, item, tokens: int, loss: int) -> None:
        """The last ``loss`` tokens of an item bear loss."""
        at, whole = 0, int(min(self.limits[0], self.limits[2]))
        while tokens - at > whole:
            bearing = max(0, at + whole - max(at, tokens - loss))
            self.done.append((item, at, whole, bearing, self.sequence, 0))
            self.sequence += 1
            at += whole
        self.size[len(self.items)] = (tokens - at, 1, min(loss, tokens - at)) / self.limits
        self.items.append((item, at, tokens, min(loss, tokens - at)))
        if len(self.items) >= self.most:
            self.place(self.most // 2)

    def place(self, down_to: int) -> None:
        while (n := len(self.items)) > down_to:
            k = int(np.argmax(self.size[:n] @ (self.rest / self.limits)))
            item, at, end, loss = self.items[k]
            tokens = end - at
            take = int(min(tokens, self.rest[0]))
            # loss-bearing tokens are the last ones: cut where the sequence can bear no more of them
            if tokens - take < loss and loss - (tokens - take) > self.rest[2]:
                take = int(tokens - loss + self.rest[2])
            bearing = max(0, take - (tokens - loss))
            if take:
                self.pieces.append((item, at, take, bearing))
                self.rest -= (take, 1, bearing)
            if take == tokens:
                self.items[k] = self.items[-1]
                self.items.pop()
                self.size[k] = self.size[n - 1]
            else:
                self.items[k] = (item, at + take, end, loss - bearing)
                self.size[k] = (tokens - take, 1, loss - bearing) / self.limits
            if self.rest[0] <= 0 or self.rest[1] < 1 or self.rest[2] <= 0 or not take:
                self.close()

    def close(self) -> None:
        """Lay the open pieces out in sequences without padding: a full one, or powers of two."""
        pieces, total = self.pieces, sum(p[2] for p in self.pieces)
        self.pieces, self.rest = [], self.limits.copy()
        while total:
            room = int(self.limits[0]) if total >= self.limits[0] else 1 << (total.bit_length() - 1)
            offset, keep = 0, []
            for item, at, n, bearing in pieces:
                take = min(n, room - offset)
                if take:
                    bears = max(0, take - (n - bearing))
                    self.done.append((item, at, take, bears, self.sequence, offset))
                    offset += take
                    bearing -= bears
                if take < n:
                    keep.append((item, at + take, n - take, bearing))
            self.sequence += 1
            pieces, total = keep, total - room

    def taken(self) -> list:
        out, self.done = self.done, []
        return out


def pack(docs: DataFrame, tokenizer: str, limits: tuple[int, int, int] = LIMITS, loss: str | None = None) -> DataFrame:
    """One row per piece of a document; see SCHEMA. Sequences keep the three limits."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, packer = word_ids(tokenizer), Packer(limits)
        first = TaskContext.get().partitionId() << 40
        end = np.array([END_ID], "<u4").tobytes()
        held: dict[int, list] = {}
        n = 0

        def rows() -> pa.RecordBatch:
            out = []
            for k, at, length, bearing, sequence, offset in packer.taken():
                doc = held[k]
                out.append((doc[0], at, length, zlib.crc32(doc[1][4 * at : 4 * (at + length)]), len(doc[1]) // 4, first + sequence, offset, bearing))
                doc[2] -= length
                if not doc[2]:
                    del held[k]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * len(names))], names=names)

        for block in blocks(batches):
            texts = block.column("text").to_pylist()
            for doc_id, text, bearing in zip(block.column("doc_id").to_pylist(), texts, block.column("loss").to_pylist(), strict=True):
                data = ids.encode(text) + end
                held[n] = [doc_id, data, len(data) // 4]
                tokens = len(data) // 4
                packer.add(n, tokens, tokens if bearing is None else min(max(bearing, 0), tokens))
                n += 1
            yield rows()
        packer.place(0)
        packer.close()
        yield rows()

    bears = docs[loss].cast("long") if loss else F.lit(None).cast("long")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), bears.alias("loss"))
    return rows.mapInArrow(task, SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
