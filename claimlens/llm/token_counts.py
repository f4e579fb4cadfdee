"""Operator 2, token counts: prefix dynamic programming over byte-level BPE.

For every prefix of a pre-token the last token of its encoding is the one token that
ends there and is compatible with the last token of the prefix before it: two tokens
are compatible if encoding their joined bytes gives the two back. So one pass over a
pre-token gives the exact number of tokens of every prefix; the new pre-tokens of a block
go through that pass side by side, place by place. White space before a word
and special strings belong to the unit they precede or form, as a prefix that ends
inside them is split differently from the whole text; their tables are made of those of
the runs and words that such prefixes are split into. A text's table is the tables of its units, laid end to end and kept as one
signed byte a code point (the change of the count), so truncation and budget questions
are answered by sums over it, without encoding again. The first byte of a table says how
wide its numbers are: 1, or 4 for a text where some change needs more than a byte.

Defined results: null counts as empty; an empty text has no token and no change in its table;
repeated rows give one row each; an empty table gives none; other columns are not read.
Special strings inside a text are special tokens, the library's default. A pre-token of
any length is counted, with a few bytes of memory for each of its bytes.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import Merges, byte_letters
from .common import blocks, documents, id_and_text, tokenizer_path

OVER = 512
#: Units whose tables a worker keeps, and how long they may be.
CACHED = 800_000
LONG = 64
#: The byte-level pre-tokenizer's pattern and Unicode's white space.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, prefix_changes binary"


class PrefixCounts(dict):
    """Exact token counts of all prefixes, for one byte-level BPE vocabulary: a memory of the tables of units.

    A table is bytes, or a list where some change needs more than a byte.
    """

    def __init__(self, path: str):
        import regex

        super().__init__()
        self.merges = Merges(path)
        self.special = [t["content"] for t in self.merges.spec["added_tokens"]]
        self.pre_token = regex.compile(PRE_TOKEN)
        special = "|".join(map(re.escape, self.special))
        self.special_unit = re.compile(special) if special else None
        self.unit = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        self.plain = regex.compile(r" ?\p{L}+").fullmatch
        #: Changes along the short pre-tokens of the block at hand.
        self.known: dict[str, bytes] = {}
        self.build()

    def build(self) -> None:
        """The tokens as a tree read from their last byte: sorted keys (node, byte), the nodes they lead to, the token of each node."""
        byte = {letter: b for b, letter in byte_letters().items()}
        tree: dict[int, int] = {}
        token = [-1]
        self.longest = 1
        for name, k in self.merges.vocab.items():
            if not self.merges.own[k]:
                continue
            node = 0
            for letter in reversed(name):
                key = node << 8 | byte[letter]
                node = tree.get(key, 0)
                if not node:
                    node = tree[key] = len(token)
                    token.append(-1)
            token[node] = k
            self.longest = max(self.longest, len(name))
        self.tree, self.token = tree, np.array(token)
        self.keys = np.fromiter(tree, np.int64, len(tree))
        order = np.argsort(self.keys)
        self.keys, self.nodes = self.keys[order], np.fromiter(tree.values(), np.int64, len(tree))[order]

    def learn(self, pre_tokens: Iterable[str]) -> None:
        """Changes of the count along many short pre-tokens at once, by code point."""
        words = [w for w in pre_tokens if w not in self.known]
        raw = [w.encode() for w in words]
        for w in (w for w, r in zip(words, raw, strict=True) if len(r) > 127):  # no change of the others needs more than a byte
            self.known[w] = packed(self.long_counts(w))
        words, raw = [w for w in words if w not in self.known], [r for r in raw if len(r) <= 127]
        if not words:
            return
        size = np.array([len(r) for r in raw])
        order = np.argsort(-size, kind="stable")
        words, raw, size = [words[k] for k in order], [raw[k] for k in order], size[order]
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        first = np.cumsum(size) - size
        # place first + k + e of these holds what is known of the prefix of e bytes of word k
        last, count = np.full(len(data) + len(words), -1, np.int64), np.zeros(len(data) + len(words), np.int32)
        base = first + np.arange(len(words))
        for end in range(1, int(size[0]) + 1):
            todo = np.arange(int(np.searchsorted(-size, -end, "right")))
            node, n = np.zeros(len(todo), np.int64), 0
            while len(todo):
                n += 1
                if n > min(end, self.longest):
                    raise ValueError("no token ends this prefix")
                key = node << 8 | data[first[todo] + end - n]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                if (self.keys[at] != key).any():
                    raise ValueError("no token ends this prefix")
                node = self.nodes[at]
                token = self.token[node]
                before = base[todo] + end - n
                fits = token >= 0
                held = np.flatnonzero(fits)
                fits[held] = self.merges.compatible(last[before[held]], token[held])
                here = base[todo[fits]] + end
                last[here] = token[fits]
                count[here] = count[before[fits]] + 1
                todo, node = todo[~fits], node[~fits]
        # what is told of a word: the counts at the ends of its code points
        ends = np.ones(len(data), bool)
        ends[:-1] = data[1:] & 0xC0 != 0x80
        ends[first[1:] - 1] = True
        told = np.zeros(len(count), bool)
        told[base] = True
        told[np.arange(len(data)) + np.repeat(np.arange(1, len(words) + 1), size)] = ends
        steps = np.diff(count[told]).astype(np.int8).tobytes()
        at = 0
        for w in words:
            self.known[w] = steps[at : at + len(w)]
            at += len(w) + 1

    def long_counts(self, pre_token: str) -> list[int]:
        """Tokens of each prefix of one long pre-token."""
        raw, tree, token_of, memory = pre_token.encode(), self.tree, self.token, {}
        reach = self.longest + 1
        last, count = [-1] * reach, array("i", [0])
        for end in range(1, len(raw) + 1):
            node = 0
            for n in range(1, min(end, self.longest) + 1):
                node = tree.get(node << 8 | raw[end - n], 0)
                token = int(token_of[node]) if node else -1
                if token >= 0:
                    pair = (last[(end - n) % reach], token)
                    fits = memory.get(pair)
                    if fits is None:
                        fits = memory[pair] = bool(self.merges.compatible(np.array(pair[:1]), np.array(pair[1:]))[0])
                    if fits:
                        break
            else:
                raise ValueError("no token ends this prefix")
            last[end % reach] = token
            count.append(count[end - n] + 1)
        if len(raw) == len(pre_token):
            return count[1:]
        return array("i", (count[k] for k in range(1, len(raw) + 1) if k == len(raw) or raw[k] & 0xC0 != 0x80))

    def token_counts(self, pre_token: str) -> list[int]:
        """Tokens of each prefix of a pre-token, by code point."""
        if len(pre_token) > LONG:
            return self.long_counts(pre_token)
        own = self.known.get(pre_token)
        if own is None:
            self.learn([pre_token])
            own = self.known[pre_token]
        return list(accumulate(unpacked(own)))

    def total(self, text: str) -> int:
        """Tokens of a whole text without special strings."""
        return sum(self.token_counts(p)[-1] for p in self.pre_token.findall(text))

    def parts(self, unit: str) -> tuple[int, list[str]]:
        """The white space that leads a unit, by length, and all its pre-tokens."""
        pieces = self.pre_token.findall(unit)
        blank = 0
        while blank < len(pieces) and pieces[blank][0] in SPACE and pieces[blank][-1] in SPACE and blank + 1 < len(pieces):
            blank += 1
        return blank, pieces

    def prepare(self, texts: list[str]) -> list[list[str]]:
        """The units of all texts of a block; the short pre-tokens of those not seen before are learnt at once."""
        if len(self) > CACHED:
            self.clear()
        units = [self.units(t) for t in texts]
        asked: set[str] = set()
        for u in set(chain.from_iterable(units)):
            if u in self or len(u) > LONG:
                continue
            if self.plain(u):
                asked.add(u)
                continue
            blank, pieces = self.parts(u)
            asked.update(pieces)
            asked.update(p[1:] for p in pieces if p[0] == "'" and len(p) > 1)
            if blank:
                lead = sum(map(len, pieces[:blank]))
                asked.add(u[:lead])
                if u[lead] == " ":
                    asked.add(u[: lead + 1])
        # a word that is a unit of its own has that unit's table
        self.known = {w: held for w in asked if (held := self.get(w)) is not None and self.plain(w)}
        self.learn(w for w in asked if w not in self.known)
        self.update((w, self.known[w]) for w in asked if self.plain(w))
        return units

    def table(self, unit: str) -> bytes | list[int]:
        """Changes of the count along a unit of white space, then other characters."""
        if unit in self.known and unit[0] != "'":
            return self.known[unit]
        blank, pieces = self.parts(unit)
        if not blank and len(unit) <= LONG and not any(p[0] == "'" for p in pieces):
            if any(p not in self.known for p in pieces):
                self.learn(pieces)
            own = [self.known[p] for p in pieces]
            if not any(isinstance(x, list) for x in own):
                return b"".join(own)
        counts = array("i")
        base = 0
        lead = sum(map(len, pieces[:blank]))
        if lead:  # a prefix that ends in the white space has it as one pre-token
            run = unit[:lead]
            counts.extend(self.token_counts(run))
            base = sum(self.token_counts(p)[-1] for p in pieces[:blank])
        for k, p in enumerate(pieces[blank:]):
            own = self.token_counts(p)
            if p[0] == "'" and len(p) > 1 and p[1].isalpha():  # a contraction that is not whole yet is two pre-tokens
                own = [own[0], *(1 + self.token_counts(p[1:])[j] for j in range(len(p) - 2)), own[-1]]
            if not k and lead and p[0] == " ":
                counts.append(self.token_counts(unit[: lead + 1])[-1])
                counts.extend(c + base for c in own[1:])
            else:
                counts.extend(c + base for c in own)
            base = counts[-1]
        return packed(counts)

    def special_table(self, unit: str) -> bytes | list[int]:
        """Of a unit that ends in a special string: as plain text up to its last character, with which the string is one token."""
        special = next(s for s in self.special if unit.endswith(s))
        counts = array("i")
        for u in self.unit.findall(unit):
            counts.extend(list(accumulate(unpacked(self.table(u)), initial=counts[-1] if counts else 0))[1:])
        counts[-1] = self.total(unit[: -len(special)]) + 1
        return packed(counts)

    def __missing__(self, unit: str) -> bytes | list[int]:
        held = self.special_table(unit) if self.special_unit and self.special_unit.search(unit) else self.table(unit)
        if len(unit) <= LONG:
            self[unit] = held
        return held

    def units(self, text: str) -> list[str]:
        if not self.special_unit or not self.special_unit.search(text):
            return self.unit.findall(text)
        out, at = [], 0
        for m in self.special_unit.finditer(text):
            start = m.start()
            # the special string's unit begins where the punctuation, then the white space before it begin
            while start > at and not text[start - 1].isalnum() and text[start - 1] not in SPACE:
                start -= 1
            while start > at and text[start - 1] in SPACE:
                start -= 1
            out += self.unit.findall(text[at:start])
            out.append(text[start : m.end()])
            at = m.end()
        return out + self.unit.findall(text[at:])

    def count(self, text: str, units: list[str] | None = None) -> tuple[bytes, int]:
        """The table of a text, and its tokens."""
        units = self.units(text) if units is None else units
        try:
            table = b"".join([b"\1", *map(self.__getitem__, units)])
        except TypeError:
            table = b"\4" + b"".join(np.array(unpacked(self[u]), "<i4").tobytes() for u in units)
        return table, int(changes(table).sum(dtype=np.int64))


def packed(counts: array) -> bytes | list[int]:
    """Changes of the count as signed bytes, or a list of them where one is too large."""
    if not counts:
        return b""
    steps = [b - a for a, b in zip(chain((0,), counts), counts, strict=False)]
    return bytes([x & 255 for x in steps]) if min(steps) >= -128 and max(steps) <= 127 else steps


def unpacked(steps: bytes | list[int]) -> list[int]:
    return steps if isinstance(steps, list) else np.frombuffer(steps, np.int8).tolist()


def changes(table: bytes) -> np.ndarray:
    """The numbers of a stored table."""
    return np.frombuffer(table, "<i4" if table[:1] == b"\4" else np.int8, offset=1)


def tokens_at(table: bytes, code_points: int) -> int:
    """Tokens of the first code points of a text, from its stored table."""
    return int(changes(table)[:code_points].sum(dtype=np.int64))


def longest_prefix(table: bytes, budget: int) -> int:
    """The most code points of which no more than ``budget`` tokens are made."""
    fits = np.flatnonzero(np.cumsum(changes(table), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


@lru_cache(maxsize=2)
def prefix_counts(path: str) -> PrefixCounts:
    """One per worker, so what a task has learnt serves the next."""
    return PrefixCounts(path)


def prefix_token_counts(docs: DataFrame, tokenizer: str, over: int = OVER) -> DataFrame:
    """One row per document with its token count and the table of all prefixes; see SCHEMA."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = prefix_counts(tokenizer)
        for block in blocks(batches):
            texts = block.column("text").to_pylist()
            found = [counts.count(t, u) for t, u in zip(texts, counts.prepare(texts), strict=True)]
            n = pa.array([x[1] for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), n, pa.array([x[1] > over for x in found]), pa.array([x[0] for x in found], pa.binary())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "prefix_changes"],
            )

    return id_and_text(docs).mapInArrow(task, SCHEMA)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_token_counts(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json")).drop("prefix_changes")
