"""Secret scans and benchmark decontamination against plain versions, on mixed and on very long texts."""

import hashlib
import random
import re

import pyarrow as pa
import pytest

from claimlens.llm import decontaminate, secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KINDS = ("assign", "access", "hex")


def plain_base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


class Each:
    """A field that takes every second token for a secret."""

    def decode(self, tokens):
        return [(k, k + 1) for k in range(0, len(tokens.words), 2)]


def mixed(rng):
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([8, 23, 24, 40])))
    parts = [hexes, f"token={hexes}", f"API_KEY: '{hexes[:7]}", "AKIA" + "B7" * rng.randrange(6, 10), f"passwd =  AKIA{'C' * 20}", "é", "漢字", "\n", "secret", "İkey", "apikey\"=\"short", "ſecret=abcdefgh", "word", "x" * 30]
    return rng.choice([" ", "", "é "]).join(rng.choice(parts) for _ in range(rng.randrange(40)))


def test_spans_of_mixed_texts_against_plain_ones():
    rng = random.Random(8)
    texts = [mixed(rng) for _ in range(400)] + ["", "a"]
    tokens = secrets.Tokens(pa.array(texts))
    words, want = tokens.words, [[] for _ in texts]
    for i, j in Each().decode(tokens):
        k = int(tokens.of[i])
        raw = words.data[words.off[k] : words.off[k + 1]].tobytes()
        a, b = (len(raw[: int(x - words.off[k])].decode()) for x in (words.start[i], words.end[j - 1]))
        if all(b <= x or y <= a for x, _, y in plain_base(texts[k])):
            want[k].append((a, 3, b))
    for text, extra, (base, found) in zip(texts, want, secrets.all_spans(pa.array(texts), Each()), strict=True):
        assert base == plain_base(text) and found == sorted(base + extra)
    assert any(want)


def test_scan_against_plain_patterns(spark):
    rng = random.Random(9)
    rows = [(k, mixed(rng)) for k in range(300)] + [(300, None), (300, None), (None, "token: abcdef12"), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.scan(docs, secrets.fit(docs)).collect())
    want = []
    for k, text in rows:
        spans = plain_base(text or "")
        said = ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)
        want.append((k is None, k or 0, *(sum(s[1] == kind for s in spans) for kind in range(3)), hashlib.sha256(said.encode()).hexdigest()))
    assert got == sorted(want)


def test_a_long_text_of_very_many_spans():
    text = " ".join(["é token=abcdef99 word"] * 100_000)  # quadratic work would not end here
    ((base, found),) = secrets.all_spans(pa.array([text]), Each())
    assert len(base) == 100_000 and len(found) >= len(base)


def test_runs():
    rng = random.Random(1)
    for _ in range(200):
        starts, gap = sorted({rng.randrange(-5, 80) for _ in range(rng.randrange(20))}), rng.randrange(8)
        want = []
        for s in starts:
            if want and s <= want[-1][1] + gap:
                want[-1] = (want[-1][0], s)
            else:
                want.append((s, s))
        assert list(decontaminate.runs(starts, gap)) == want


def least(pattern, text):
    """The least edit distance of the pattern to any stretch of the text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        row, old = [i], row
        for j, d in enumerate(text, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (c != d)))
    return min(row)


@pytest.mark.parametrize("seed", [1, 2])
def test_decontamination_against_plain_distances(spark, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(12)]
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, " ".join(draw(rng.choice([3, 5, 9, 10, 17, 25])))) for k in range(25)]
    docs = [(0, ""), (1, None), (2, " ".join(draw(40)))]
    for k in range(3, 160):
        parts = draw(rng.randrange(30))
        for _ in range(rng.randrange(3)):
            own = rng.choice(items)[1].split()
            for _ in range(rng.randrange(6)):
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(2)] = rng.choice([[], [rng.choice(words)]])
                own = own or ["w0"]
            parts += own + draw(rng.randrange(9))
        docs.append((k, rng.choice([" ", ", "]).join(parts).upper()))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.match(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, text in docs:
        have = re.findall("[a-z0-9]+", (text or "").lower())
        for i, item in items:
            most, distance = max(len(item.split()) // 5 - 1, 0), least(item.split(), have)
            if distance <= most:
                want[d, i] = distance
    assert got == want and len(want) > 50


def test_a_long_text_that_repeats_an_item(spark):
    rng = random.Random(5)
    item = [f"v{rng.randrange(1000)}" for _ in range(20)]
    gap = [f"u{k}" for k in range(30)]
    text = " ".join((item + gap) * 20_000)  # 20,000 runs of starts of one item in one text
    docs = spark.createDataFrame([(1, text), (2, " ".join(item * 3000)), (3, " ".join(gap))], "doc_id long, text string")
    rows = decontaminate.match(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.distance, r.first_word, r.last_word) for r in rows) == [(1, 0, 0, 19), (2, 0, 0, 19)]
