"""The merges of a byte-level BPE vocabulary as arrays: which adjacent tokens stay apart, for many pairs at once.

Used inside Spark tasks by operators 1 and 2; a tokenizer is read from its file, never trained.
"""

from __future__ import annotations

import json

import numpy as np

NEVER = 1 << 40
_SHIFT = np.int64(20)
#: Slots of the memory of pairs; a slot holds the last pair that fell into it.
SLOTS = 1 << 20


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself where printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    out |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in out)}
    return out


class Merges:
    """Ids, parts and ranks of all tokens, and whether two tokens stay two when their bytes are encoded together."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.vocab: dict[str, int] = self.spec["model"]["vocab"]
        size = max(self.vocab.values()) + 1
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in self.spec["model"]["merges"]]
        x, y = (np.array([self.vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        made = np.array([self.vocab[m[0] + m[1]] for m in merges], np.int64)
        back = np.arange(len(merges))[::-1]  # of two merges that make one token the first stands
        self.rank[made[back]], self.left[made[back]], self.right[made[back]] = back, x[back], y[back]
        keys = x << _SHIFT | y
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.seen = np.full(SLOTS, -1, np.int64)
        self.own = self.rank < 0
        of = np.flatnonzero(self.rank >= 0)
        apart = np.zeros(size, bool)
        apart[of] = self.stay(self.left[of], self.right[of], self.rank[of])
        for t in of[np.argsort(self.rank[of])].tolist():
            self.own[t] = apart[t] and self.own[self.left[t]] and self.own[self.right[t]]

    def stay(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Undo the merges of both tokens, the latest first: they join if what then meets merges before the merge undone."""
        out = np.ones(len(a), bool)
        alive = np.arange(len(a))
        before = np.full(len(a), NEVER) if before is None else before
        while len(alive):
            key = a << _SHIFT | b
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            joined = (self.keys[at] == key) & (self.ranks[at] < before)
            out[alive[joined]] = False
            of_a, of_b = self.rank[a], self.rank[b]
            on = np.flatnonzero(~joined & ((of_a >= 0) | (of_b >= 0)))
            alive, a, b, of_a, of_b = alive[on], a[on], b[on], of_a[on], of_b[on]
            undo_a = of_a > of_b  # of equal merges the left one comes first
            before = np.where(undo_a, of_a, of_b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``stay`` by the memory of pairs; a < 0: whether b is its own encoding."""
        key = (a + 1) << _SHIFT | b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        held = self.seen[slot]
        out = (held & 1).astype(bool)
        new = np.flatnonzero(held >> 1 != key)
        if len(new):
            fresh, back = np.unique(key[new], return_inverse=True)
            x, y = (fresh >> _SHIFT) - 1, fresh & ((1 << 20) - 1)
            fits = np.empty(len(fresh), bool)
            start = x < 0
            fits[start] = self.own[y[start]]
            fits[~start] = self.stay(x[~start], y[~start])
            out[new] = fits[back]
            self.seen[slot[new]] = key[new] << 1 | out[new]
        return out
