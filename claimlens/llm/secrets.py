"""Operator 8, secret scans: a linear-chain conditional random field over tokens.

Tokens are runs of letters, digits, ``+/_.-`` and non-ASCII bytes. Each is tagged secret
begin, inside or outside from its shape, its neighbouring words and features of the file,
decoded by Viterbi. Base patterns give spans of their own, which always stay; the field
adds spans of kind ``crf`` that touch none of them.

The field is fitted by gradient steps on the conditional likelihood, in one task, on
windows of tokens from at most ``TRAIN_ROWS`` texts (a documented bound), tagged by the
base patterns. So that it learns what secrets look like, and not the patterns, every text
with a secret is given again in forms that the patterns miss (``variants``): without its
keyword, in capitals, cut short. Long tokens with digits that are no secrets, such as mail
addresses, are shown as such. Its weight tables (a fixed size) are broadcast. In decoding, a token whose
outside score exceeds its other scores by more than its change to outside can cost must
be outside on the best path, so the path splits there without change; only the stretches
between such tokens run Viterbi step by step. The cost counts the transitions about the
token, and what follows it: inside can't follow outside, so an inside tail must then begin
a span of its own or go outside as well.

Defined results: null or empty texts have no span; repeated rows give one row each; an
empty table gives none; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Words, blocks, bounded_sample, documents, id_and_text, mix

TRAIN_ROWS = 4000
REACH = 8
STEPS = 120
#: Windows that the field is fitted on at most; those about base matches come first.
WINDOWS = 6000
NEVER = -1e4
#: Tokens after an outside one that decoding looks at to bound the cost of the change.
LOOK = 3
KINDS = ("assign", "access", "hex", "crf")
OUT, BEGIN, INSIDE = 0, 1, 2

#: The base patterns and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("passw", "secret", "token", "api_key", "apikey")

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"

_TOKEN = np.ones(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_.-", *range(128, 256)]] = False
_KIND = np.full(256, 8, np.uint8)
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 4, 1, 2, 16
_KIND[_TOKEN] = 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches, in code points."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS) or not text.isascii():
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


class Tokens:
    """Tokens of a block with the codes of their features."""

    def __init__(self, text: pa.Array):
        self.words = words = Words(text, _TOKEN, LOWER)
        self.of = words.text_of()
        n = len(words)
        if not n:
            self.codes = np.zeros((4, 0), np.int64)
            return
        kinds = _KIND[words.data]
        changes = np.zeros(len(kinds), np.int64)
        changes[1:] = kinds[1:] != kinds[:-1]
        turns = np.add.reduceat(changes, words.start) - changes[words.start]
        size = words.end - words.start
        shape = np.bitwise_or.reduceat(kinds, words.start).astype(np.int64)
        length = np.searchsorted([4, 8, 12, 16, 20, 24, 32], size, "right")
        share = np.searchsorted([0.1, 0.25, 0.5, 0.8], turns / size, "right")
        word = (mix(words.hashes(8)) & np.uint64(4095)).astype(np.int64)
        digits = np.bincount(self.of, (shape & 4) > 0, minlength=len(text)) / np.maximum(np.diff(words.first), 1)
        file = np.searchsorted([0.002, 0.01, 0.03, 0.1, 0.3], digits, "right") * 4 + np.searchsorted([20, 200, 2000], np.diff(words.first), "right")
        before, after = np.full(n, 4096), np.full(n, 4096)
        same = self.of[1:] == self.of[:-1]
        before[1:][same], after[:-1][same] = word[:-1][same], word[1:][same]
        self.codes = np.stack([(shape * 8 + length) * 5 + share, before, after, file[self.of]])


SIZES = (32 * 8 * 5, 4097, 4097, 24)


class Field:
    """Weights of features by tag, and of tag pairs."""

    def __init__(self) -> None:
        self.tables = [np.zeros((s, 3)) for s in SIZES]
        self.pairs = np.zeros((3, 3))
        self.pairs[OUT, INSIDE] = NEVER

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        return sum(t[c] for t, c in zip(self.tables, codes, strict=True))

    def fit(self, codes: np.ndarray, tags: np.ndarray) -> None:
        """Gradient ascent with per-weight steps on windows (feature, window, place) and tags (window, place)."""
        if not len(tags):
            self.tables[0][:, OUT] = 50.0
            return
        rows, width = tags.shape
        seen = [np.full_like(t, 1e-3) for t in self.tables]
        pair_seen = np.full((3, 3), 1e-3)
        gold = np.eye(3)[tags]
        gold_pairs = np.einsum("ni,nj->ij", gold[:, :-1].reshape(-1, 3), gold[:, 1:].reshape(-1, 3))

        def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis, keepdims=True)
            return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)

        for _ in range(STEPS):
            score = self.emissions(codes)
            ahead, behind = np.zeros((width, rows, 3)), np.zeros((width, rows, 3))
            ahead[0] = score[:, 0] + np.array([0, 0, NEVER])
            for k in range(1, width):
                ahead[k] = log_sum(ahead[k - 1][:, :, None] + self.pairs, 1) + score[:, k]
            for k in range(width - 2, -1, -1):
                behind[k] = log_sum(self.pairs + (score[:, k + 1] + behind[k + 1])[:, None, :], 2)
            whole = log_sum(ahead[-1], 1)
            mine = np.exp(ahead + behind - whole[None, :, None]).transpose(1, 0, 2)
            pairs = sum(np.exp(ahead[k - 1][:, :, None] + self.pairs + (score[:, k] + behind[k])[:, None, :] - whole[:, None, None]).sum(0) for k in range(1, width))
            diff = (gold - mine).reshape(-1, 3)
            for t, s, c in zip(self.tables, seen, codes, strict=True):
                g = np.stack([np.bincount(c.ravel(), diff[:, y], minlength=len(t)) for y in range(3)], 1) - 0.02 * t
                s += g * g
                t += 0.5 * g / np.sqrt(s)
            g = gold_pairs - pairs
            g[OUT, INSIDE] = 0
            pair_seen += g * g
            self.pairs += 0.5 * g / np.sqrt(pair_seen)

    def decode(self, tokens: Tokens) -> list[tuple[int, int]]:
        """Spans of tokens (first, after the last) tagged begin and inside on the best path of each text."""
        if not len(tokens.of):
            return []
        score = self.emissions(tokens.codes)
        allowed = self.pairs[self.pairs > NEVER / 2]
        step = float(allowed.max() - allowed.min())
        # the most it can cost, with its transitions, to take an inside token whose predecessor has gone outside into
        # another tag: begin, or outside and so on with the next token (LOOK steps of that; begin always does)
        follows = np.append(tokens.of[1:] == tokens.of[:-1], False)
        begin = score[:, INSIDE] - score[:, BEGIN] + 2 * step
        cost = begin
        for _ in range(LOOK):
            cost = np.minimum(begin, score[:, INSIDE] - score[:, OUT] + step + self.tail(cost, follows, step))
        open_ = score[:, OUT] - np.maximum(score[:, BEGIN], score[:, INSIDE]) <= step + self.tail(cost, follows, step) + 1e-9
        at = np.flatnonzero(open_)
        if not len(at):
            return []
        cuts = np.flatnonzero((np.diff(at) > 1) | (tokens.of[at[1:]] != tokens.of[at[:-1]])) + 1
        out = []
        for run in np.split(at, cuts):
            a, b = int(run[0]), int(run[-1]) + 1
            left = a > 0 and tokens.of[a - 1] == tokens.of[a]
            right = b < len(tokens.of) and tokens.of[b] == tokens.of[a]
            out += [(a + i, a + j) for i, j in self.best(score[a:b], left, right)]
        return out

    @staticmethod
    def tail(cost: np.ndarray, follows: np.ndarray, step: float) -> np.ndarray:
        """The most that the next token of the same text costs where this one goes outside: the transition, or its change."""
        return np.where(follows, np.maximum(step, np.append(cost[1:], 0)), step)

    def best(self, score: np.ndarray, left: bool, right: bool) -> list[tuple[int, int]]:
        total = score[0] + (self.pairs[OUT] if left else np.array([0, 0, NEVER]))
        back = []
        for s in score[1:]:
            paths = total[:, None] + self.pairs
            back.append(paths.argmax(0))
            total = paths.max(0) + s
        tag = int((total + (self.pairs[:, OUT] if right else 0)).argmax())
        tags = [tag]
        for b in reversed(back):
            tags.append(tag := int(b[tag]))
        tags.reverse()
        out, start = [], None
        for k, t in enumerate([*tags, OUT]):
            if start is not None and t != INSIDE:
                out.append((start, k))
                start = None
            if t == BEGIN:
                start = k
        return out


def tagged(texts: list[str], tokens: Tokens, spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """Tags of tokens that lie in the value part of base matches, or in other spans given."""
    tags = np.zeros(len(tokens.of), np.int64)
    words = tokens.words
    for k, (text, own) in enumerate(zip(texts, spans, strict=True)):
        values = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        values += [(a, b) for a, kind, b in own if kind]
        for a, b in values:
            a, b = (words.off[k] + len(text[:x].encode()) for x in (a, b))
            i, j = np.searchsorted(words.start, a - 1), np.searchsorted(words.start, b)
            if (i < j and words.end[i] <= a) or (i < j and words.start[i] < a and words.end[i] > a and words.start[i] < a - 1):
                i += 1
            if i < j:
                tags[i] = BEGIN
                tags[i + 1 : j] = INSIDE
    return tags


def variants(text: str, spans: list[tuple[int, int, int]], most: int = 400) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The surroundings of each long secret in forms that no base pattern finds, and where the secret stands in each."""
    out = []
    for a, kind, b in spans:
        found = ASSIGN.match(text, a, b)
        secret = found[2] if found else text[a:b]
        if len(secret) < 20:
            continue
        before, after = text[max(0, a - most) : a], text[b : b + most]
        for word, form in (("", secret.upper()), ("key ", secret[:23]), ("", secret[:20]), ("bearer ", secret.swapcase())):
            lead = before + word
            out.append((lead + form + after, [(len(lead), 3, len(lead) + len(form))]))
    return out


def fit(docs: DataFrame, most: int = TRAIN_ROWS) -> Field:
    rows = id_and_text(docs)
    rows = rows.join(F.broadcast(bounded_sample(rows, "doc_id", most)), "doc_id").dropDuplicates(["doc_id"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, tags = [], []
        width = 2 * REACH + 1
        for block in blocks(batches):
            texts = block.column("text").to_pylist()
            spans = [base_spans(t) for t in texts]
            more = [v for t, own in zip(texts, spans, strict=True) for v in variants(t, own)]
            texts, spans = texts + [t for t, _ in more], spans + [own for _, own in more]
            tokens = Tokens(pa.array(texts, pa.string()))
            tag = tagged(texts, tokens, spans)
            size = tokens.words.end - tokens.words.start
            shape = tokens.codes[0] // 40
            like = np.flatnonzero((tag == OUT) & (size >= 8) & (shape & 4 > 0))  # long with digits, no secret
            own = np.concatenate([np.flatnonzero(tag == BEGIN), like, np.arange(REACH, len(tag), 997)])
            for k in own.tolist():
                a = max(0, min(k - REACH, len(tag) - width))
                if a + width <= len(tag) and tokens.of[a] == tokens.of[a + width - 1]:
                    codes.append(tokens.codes[:, a : a + width])
                    tags.append(tag[a : a + width])
        told = np.random.default_rng(0).permutation(len(tags)).tolist()  # of too many, an even share of each sort
        codes, tags = [codes[k] for k in told], [tags[k] for k in told]
        field = Field()
        order = range(min(len(codes), WINDOWS))
        field.fit(np.stack([codes[k] for k in order], 1) if len(order) else np.zeros((4, 0, width), int), np.stack([tags[k] for k in order]) if len(order) else np.zeros((0, width), int))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((field.tables, field.pairs))], pa.binary())], names=["field"])

    field = Field()
    learnt = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(task, "field binary").first()
    if learnt:
        field.tables, field.pairs = pickle.loads(learnt[0])
    else:  # no text to learn from
        field.tables[0][:, OUT] = 50.0
    return field


def reaches(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """The starts of spans in order, and how far the spans up to each reach."""
    spans = sorted(spans)
    return [a for a, _, _ in spans], list(itertools.accumulate((b for _, _, b in spans), max))


def all_spans(text: pa.Array, field: Field) -> Iterator[tuple[list, list]]:
    """For each text of a block: the base spans, and all spans, in order."""
    texts = text.to_pylist()
    base = [base_spans(t) for t in texts]
    tokens = Tokens(text)
    words, extra = tokens.words, [[] for _ in texts]
    at, place, starts, ends = -1, None, [], []
    for i, j in field.decode(tokens):
        k = int(tokens.of[i])
        if k != at:  # a text's spans follow one another
            at, (starts, ends) = k, reaches(base[k])
            # how many characters start before each byte
            place = np.concatenate([np.zeros(1, np.int32), np.cumsum((words.data[words.off[k] : words.off[k + 1]] & 0xC0) != 0x80, dtype=np.int32)])
        a, b = (int(place[x - words.off[k]]) for x in (words.start[i], words.end[j - 1]))
        before = bisect.bisect_left(starts, b)
        if not before or ends[before - 1] <= a:
            extra[k].append((a, 3, b))
    for own, more in zip(base, extra, strict=True):
        yield own, sorted(own + more)


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """One row per document with its base counts and all spans; see SCHEMA."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            rows = []
            for doc_id, (own, found) in zip(block.column("doc_id").to_pylist(), all_spans(block.column("text"), field), strict=True):
                n = [sum(s[1] == kind for s in own) for kind in range(3)]
                rows.append((doc_id, *n, hashlib.sha256(joined(own).encode()).hexdigest(), joined(found), len(found) - len(own)))
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return id_and_text(docs).mapInArrow(task, SCHEMA)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of its spans replaced by the kind of the first of them, in brackets."""
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind]}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, field: Field) -> DataFrame:
    """All rows with the secrets in their texts masked; n_chars, if there, follows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [spans for block in blocks([batch]) for _, spans in all_spans(block.column("text"), field)]
            texts = [masked(t, s) if s else t for t, s in zip(texts, found, strict=True)]
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            if "n_chars" in batch.schema.names:
                at = batch.schema.get_field_index("n_chars")
                lengths = [n if t is None else len(t) for t, n in zip(texts, batch.column(at).to_pylist(), strict=True)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(lengths, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(task, docs.schema)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scan(docs, fit(docs))
