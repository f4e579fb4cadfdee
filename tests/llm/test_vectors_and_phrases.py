"""Brute-force checks of the vector operators and of phrase mining."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from claimlens.llm import collocations, hard_negatives, neighbours

ROWS = "vec_id long, label int, embedding array<float>, `rank` int, `score` string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, y, v, 9, "x") for i, y, v in rows], ROWS)


@pytest.fixture(scope="module")
def some():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(420):
        v = rng.standard_normal(8) if i % 3 else np.array([1.0, *rng.standard_normal(7) * 0.05])  # a third lie together
        rows.append((i, int(rng.integers(0, 4)), [float(x) for x in np.float32(v)]))
    rows[17] = (17, 1, rows[20][2])  # equal vectors: ties
    rows[23] = (23, 1, rows[20][2])
    rows += [(1000, None, rows[1][2]), (1050, 1, None), (1100, 1, [None] * 8), (1150, 2, [float("nan")] * 8), (1200, 2, [float("inf")] + [0.0] * 7), (None, 1, rows[1][2]), (1250, 3, rows[5][2][:5]), (1300, 0, [0.0] * 8), (1301, 1, []), rows[40]]
    return rows


def usable(rows):
    ok = [(i, y, [*v, *[0.0] * (8 - len(v))]) for i, y, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    return ok


def mined_plainly(rows):
    rows = [(i, y, np.floor(256 * np.array(v, float)).astype(int)) for i, y, v in usable(rows) if y is not None]
    out = set()
    for i, y, v in rows:
        if i % 50:
            continue
        scored = sorted((-int(v @ w), j, z) for j, z, w in rows)
        for s, j, _ in [r for r in scored if r[2] == y and r[1] != i][:5]:
            window = [(t, k) for t, k, z in scored if z != y and 50 * -s <= 100 * -t <= 95 * -s]
            out |= {(i, j, n, k, -s, -t) for n, (t, k) in enumerate(window[:3], 1)}
    return out


@pytest.mark.parametrize(("cells", "chunk"), [(64, 8192), (4, 300), (1, 8192)])
def test_hard_negatives(spark, some, cells, chunk):
    got = [tuple(r) for r in hard_negatives.mined(vectors(spark, some), cells=cells, chunk=chunk).collect()]
    assert len(got) == len(set(got)) > 50 and set(got) == mined_plainly(some)


def test_hard_negatives_of_hot_rows_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "QUERIES", 5)
    rng = np.random.default_rng(8)
    rows = [(i, i % 3, [3.0, 1.0, 2.0] if i % 2 else [float(x) for x in rng.integers(-3, 4, 3)]) for i in range(900)]
    got = {tuple(r) for r in hard_negatives.mined(vectors(spark, rows), chunk=256).collect()}
    want = set()
    for i, y, v in rows[::50]:
        scored = sorted((-int(256 * 256 * np.dot(v, w)), j, z) for j, z, w in rows)
        for s, j, _ in [r for r in scored if r[2] == y and r[1] != i][:5]:
            window = [(t, k) for t, k, z in scored if z != y and 50 * -s <= 100 * -t <= 95 * -s]
            want |= {(i, j, n, k, -s, -t) for n, (t, k) in enumerate(window[:3], 1)}
    assert got == want


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mined(vectors(spark, [])).collect() == []
    assert hard_negatives.mined(vectors(spark, [(1, None, [1.0]), (2, 1, None)])).collect() == []
    with pytest.raises(ArithmeticError):
        hard_negatives.mined(vectors(spark, [(50, 1, [1e30]), (2, 1, [1.0])]))


def test_tree_lets_subtrees_go_but_none_that_holds_what_is_asked():
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, (12, 6))
    points = np.concatenate([c + rng.integers(-4, 5, (80, 6)) for c in centres])
    chunk = hard_negatives.Chunk(np.arange(len(points)), np.zeros(len(points), int), points)
    queries = points[::37]
    low = (queries.astype(float) ** 2).sum(1) * 0.98
    scores, known = chunk.scores(queries, low, np.full(len(queries), 2.0**62))
    exact = queries @ chunk.vectors.T
    assert known[exact >= low[:, None]].all() and (scores[known] == exact[known]).all()
    assert known.mean() < 0.5  # clustered vectors: most leaves go


def test_products_stay_exact_where_doubles_do_not():
    a = np.array([[2**30 + 1, 3], [2**31 - 1, 2**31 - 1]])
    assert hard_negatives.products(a[:1], a[:1])[0, 0] == (2**30 + 1) ** 2 + 9
    assert hard_negatives.products(a[1:], a[1:])[0, 0] == 2 * (2**31 - 1) ** 2
    with pytest.raises(OverflowError):
        hard_negatives.products(np.full((1, 4), 2**31 - 1), np.full((1, 4), 2**31 - 1))


def nearest_plainly(rows, top=20):
    rows = [(i, np.array(v, float)) for i, _, v in usable(rows) if any(v)]
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            out[i] = sorted({(-float((v * w).sum()), j) for j, w in rows if j != i})[:top]
    return out


def test_neighbours_take_all_where_the_share_is_whole(spark, some):
    got = defaultdict(list)
    for r in neighbours.neighbours(vectors(spark, some), share=1e9, group=100).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = nearest_plainly(some)
    assert set(got) == set(want)
    for i, rows in want.items():
        own = sorted(got[i])
        assert [r[0] for r in own] == list(range(1, len(rows) + 1))
        assert [r[1] for r in own] == [j for _, j in rows]
        assert np.allclose([r[2] for r in own], [-s for s, _ in rows], rtol=0, atol=1e-12)


@pytest.mark.parametrize("clustered", [False, True])
def test_neighbours_recall(spark, clustered):
    rng = np.random.default_rng(4)
    points = rng.standard_normal((6000, 16)) * (0.2 if clustered else 1) + (rng.standard_normal((40, 16)) * 2)[rng.integers(0, 40, 6000)] * clustered
    rows = [(i, 0, [float(x) for x in np.float32(v)]) for i, v in enumerate(points)]
    got = defaultdict(set)
    for r in neighbours.neighbours(vectors(spark, rows), block=100).collect():
        got[r.query_id].add(r.vec_id)
    x = np.float32(points).astype(float)
    found = 0
    for i in range(0, 6000, 20):
        scores = x @ x[i]
        scores[i] = -np.inf
        found += len(got[i] & set(np.argsort(-scores)[:20].tolist()))
    assert found >= 0.9 * 20 * 300 and all(len(v) == 20 for v in got.values())


def test_structure_makes_the_share_small():
    rng = np.random.default_rng(4)
    tight = rng.standard_normal((4000, 16)) * 0.05 + (rng.standard_normal((100, 16)))[rng.integers(0, 100, 4000)]
    tight /= np.linalg.norm(tight, axis=1)[:, None]
    loose = rng.standard_normal((4000, 16))
    loose /= np.linalg.norm(loose, axis=1)[:, None]
    share = [neighbours.Forest(x, 1.0).share(x) for x in (tight, loose)]
    assert share[0] < 0.3 * share[1]


def test_neighbours_of_nothing(spark):
    assert neighbours.neighbours(vectors(spark, [])).collect() == []
    assert neighbours.neighbours(vectors(spark, [(20, 1, [0.0, 0.0]), (40, 1, None)])).collect() == []
    assert neighbours.neighbours(vectors(spark, [(20, 1, [1.0, 0.0])])).collect() == []
    same = [(i, 1, [1.0, 2.0]) for i in range(60)]
    rows = neighbours.neighbours(vectors(spark, same)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in rows) == [(q, k, j) for q in (0, 20, 40) for k, j in enumerate([j for j in range(60) if j != q][:20], 1)]


def mined_phrases(rows, least=10, longest=3, top=2000):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(words[k : k + m]) for k in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in cands.items():
            for m in range(2, len(p)):
                for k in range(len(p) - m + 1):
                    inside[p[k : k + m]] = max(inside[p[k : k + m]], a)
        rows_ = []
        for p, a in cands.items():
            if 100 * inside[p] >= 50 * a and inside[p]:
                continue
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def phrase_rows():
    rng = random.Random(9)
    vocab = ["The", "a", "Ärger", "x", "y", "z", "über", "q", "日本", "K", "new", "york", "city", "w" * 3000, "\x00", "\xa0"]
    rows = [(None, "en"), ("", None), (" \t,.", "de")]
    for k in range(260):
        words = [rng.choice(vocab[: 4 + k % 13]) for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", "\t", "  ", ", ", ".\n", "; ", " ", " "]) for w in words)
        rows.append((text + ("New York City " if k % 3 else ""), rng.choice(["en", "en", "en", "de", None, ""])))
    return [*rows, *rows[5:9], ("la la la " * 9000, "fr")]


@pytest.mark.parametrize(("ranked", "longest", "top"), [(1 << 19, 3, 2000), (6, 3, 2000), (0, 2, 5), (40, 4, 7)])
def test_collocations(spark, phrase_rows, ranked, longest, top):
    docs = spark.createDataFrame([(x, y, 3, "c") for x, y in phrase_rows], "text string, lang string, `n` int, `words` string").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(docs, longest=longest, top=top, ranked=ranked).collect())
    assert got == mined_phrases(phrase_rows, longest=longest, top=top) and got


def test_tiles_are_counted_densely_and_sparsely():
    rng = np.random.default_rng(2)
    left = np.concatenate([rng.integers(0, 40, 90_000), rng.integers(0, 1 << 19, 5000)])
    right = np.concatenate([rng.integers(1024, 1060, 90_000), rng.integers(0, 1 << 19, 5000)])
    codes, n = collocations.tiles(left << 32 | right)
    want = Counter((left << 32 | right).tolist())
    assert dict(zip(codes.tolist(), n.tolist(), strict=True)) == dict(want) and (np.diff(codes) > 0).all()


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(docs).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None), (" . ", "en")], docs.schema)).collect() == []
