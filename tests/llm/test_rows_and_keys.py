"""Rows that share an id or have none: op4, op5 and op6 against brute force."""

import hashlib
import random
import re

import pytest

from claimlens.llm import chat, licenses, substrings

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.mark.parametrize("partitions", [1, 2, 6])
def test_substrings_of_rows_that_share_an_id(spark, partitions):
    rng = random.Random(21)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    p, o = fresh(20), fresh(40)
    rows = [(1, p), (5, ["a", "b", "c", *p]), (5, o), (5, o), (7, [*o, *o]), (None, p), (None, fresh(14)), (0, []), (5, [*fresh(3), *o[3:30], *p, *p]), (3, fresh(13)), (9, None), (9, o[:13])]
    first = {}
    for k, w in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0]):
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), k)
    want = []
    for k, w in rows:
        w = w or []
        gone = {i + j for i in range(len(w) - 12) for j in range(13) if k is not None and first[tuple(w[i : i + 13])] < k}
        want.append((k, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    told = [(k, None if w is None else " ".join(w), "other") for k, w in rows]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(told, partitions), "doc_id long, text string, `row` string")
    spans = substrings.repeated_spans(docs)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove(docs, spans).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert substrings.verified(docs, spans).where("not same").count() == 0


def test_substrings_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.remove(docs, substrings.repeated_spans(docs)).collect() == []


def base_of(text):
    """Places and labels of the base phrases, word by word."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_licenses_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["cc", "by", "CC-BY", "general", "Public", "license", "all", "rights", "reserved", "x", "ü", "K", "K", "İ", "all  rights reserved", "General Public License,"]
    texts = [None, "", " ", "cc", "cc by " * 4000, *(" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))) for _ in range(300))]
    rows = [(rng.choice([None, 1, 2, k]), t, "z", 4) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, pos int").repartition(3)
    got = [tuple(r)[:6] for r in licenses.scan(docs).collect()]
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert sorted(got, key=key) == sorted(((k, *base_of(t)) for k, t, *_ in rows), key=key)


def told(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn if turn is not None else float("-inf"), role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    return out


def test_conversations_against_brute_force(spark):
    rng = random.Random(4)
    bits = ["<|", "|>", "\\", "</s>", "[INST]", "<|end|>\n", "<|user|>\n", "\n", "a", "ü", "\\\\", "|", "<<SYS>>", " "]
    word = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
    rows = [(conv, turn, rng.choice(["user", "assistant", "assistant", "tool|>", None, "a\\|"]), rng.choice([None, word(), word(), word()])) for conv in (None, 0, 1, 2, -1, 40) for turn in range(rng.randint(1, 9))]
    rows += [rows[0], rows[3], (77, 1, "assistant", "x" * 300_000), *((78, k, "user", str(k)) for k in range(130))]
    turns = spark.createDataFrame([(*r, 1, "y") for r in rows], "conv_id long, turn long, role string, text string, node int, conv string")
    got = [tuple(r)[:5] for r in chat.conversations_of(chat.chains(turns)).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(got, key=key) == sorted(told(rows), key=key)
    assert chat.conversations_of(chat.chains(turns.limit(0))).collect() == []


def best_paths(messages, branches):
    """Paths from roots to leaves by plain recursion, ranked by score, then leaf."""
    out = {}
    for conv in {m[0] for m in messages}:
        own = {n: (p, s) for c, n, p, s in messages if c == conv}
        parents = {p for p, _ in own.values()}
        paths = []
        for leaf in own.keys() - parents:
            path, at, score = [], leaf, 0.0
            while at in own:
                path.append(at)
                score += own[at][1] or 0.0
                at = own[at][0]
            paths.append((-score, leaf, path[::-1]))
        out[conv] = [(rank, leaf, path) for rank, (_, leaf, path) in enumerate(sorted(paths), 1)][:branches]
    return out


@pytest.mark.parametrize("branches", [1, 3, None])
def test_reply_trees_against_brute_force(spark, branches):
    rng = random.Random(6)
    messages = []
    for conv in (None, 1, 2, 3, 0):
        for node in range(rng.randint(1, 40)):
            parent = None if node < 2 or rng.random() < 0.05 else rng.choice([rng.randrange(node), node - 1, 999 + node])
            messages.append((conv, node, parent, rng.choice([None, 0.5, 0.5, 1.0, 2.0, -1.0])))  # ties among them
    table = spark.createDataFrame([(*m, "user", "t") for m in messages], "conv_id long, node long, parent long, score double, role string, text string")
    got = {}
    for r in chat.paths(table, branches).collect():
        got.setdefault(r.conv_id, {}).setdefault((r["rank"], r.leaf), []).append((r.depth, r.node))
    for conv, want in best_paths(messages, branches).items():
        assert {k: [n for _, n in sorted(v)] for k, v in got[conv].items()} == {(rank, leaf): path for rank, leaf, path in want}
