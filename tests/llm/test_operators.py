"""Small brute-force checks of the training-data operators, nulls, ties and empty tables included."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from claimlens.llm import chat, decontaminate, licenses, media, ngram_join, packing, quality, secrets, substrings, token_counts
from claimlens.llm.common import tokenizer_path
from claimlens.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, `words` int, `key` string"


def make(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(60)]
    shared = [rng.choice(vocab) for _ in range(30)]
    out = [(0, None), (1, ""), (2, "one"), (3, "one two"), (4, "One two")]
    for k in range(5, 60):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        if k % 3 == 0:
            words[5:5] = shared
        if k % 4 == 0 and k > 8:
            words = out[k - 2][1].split()
            if words and k % 8 == 0:
                words[rng.randrange(len(words))] = "changed"
        out.append((k, (" " if k % 5 else "\n ").join(words)))
    return [*out, (7000, "long " * 30_000), out[9]]


def test_packing(spark, texts):
    rows = packing.pack(make(spark, texts), tokenizer_path("word_bpe_49k.json")).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = {d: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for d, x in texts}
    sequences = {}
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        total = sum(n for _, n in pieces)
        assert total <= 4096 and len(pieces) <= packing.LIMITS[1] and total & (total - 1) == 0
        assert [o for o, _ in sorted(pieces)] == list(itertools.accumulate([0, *(n for _, n in sorted(pieces))][:-1]))
    covered = sum(r.length for r in rows)
    assert covered == sum(len(ids[d]) for d, _ in texts)
    assert packing.pack(make(spark, []), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_packing_by_loss_bearing_tokens(spark):
    rng = random.Random(12)
    rows = [(k, " ".join("word" for _ in range(rng.randint(0, 90))), rng.choice([None, 0, 3, 10, 10**6])) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bears long").coalesce(1)
    limits = (64, 5, 20)
    out = packing.pack(docs, tokenizer_path("word_bpe_49k.json"), limits, "bears").collect()
    tokens = {r.doc_id: r.doc_tokens for r in out}
    for k, _, bears in rows:
        own = sorted((r.start, r.length, r.loss_tokens) for r in out if r.doc_id == k)
        want = tokens[k] if bears is None else min(bears, tokens[k])
        assert sum(n for _, n, _ in own) == tokens[k]
        assert all(got == max(0, a + n - max(a, tokens[k] - want)) for a, n, got in own)
    for s in {r.sequence_id for r in out}:
        held = [r for r in out if r.sequence_id == s]
        assert all(x <= y for x, y in zip((sum(r.length for r in held), len(held), sum(r.loss_tokens for r in held)), limits, strict=True))
    assert {r.loss_tokens == r.length for r in packing.pack(docs, tokenizer_path("word_bpe_49k.json")).collect()} == {True}


def test_packer_keeps_all_limits():
    packer, rng = packing.Packer((100, 5, 40), 16), random.Random(1)
    sizes = [(n := rng.randint(1, 180), rng.randint(0, n)) for _ in range(300)]
    for k, (n, loss) in enumerate(sizes):
        packer.add(k, n, loss)
    packer.place(0)
    packer.close()
    pieces, got = {}, {}
    for item, _, n, loss, sequence, _ in packer.taken():
        pieces.setdefault(sequence, []).append((n, loss))
        got[item] = tuple(np.add(got.get(item, (0, 0)), (n, loss)))
    assert all(sum(n for n, _ in p) <= 100 and len(p) <= 5 and sum(x for _, x in p) <= 40 for p in pieces.values())
    assert [got[k] for k in range(300)] == sizes


def test_token_counts(spark, texts):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    t, counts, rng = Tokenizer.from_file(path), token_counts.PrefixCounts(path), random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'s", "'", "'re", "é", "1", "!", "-", "<|endoftext|>", "<|endo", "　", "\xa0", "\x1c", "漢", "😀", "́"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        table, n = counts.count(text)
        exact = [len(t.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert n == exact[-1] and [token_counts.tokens_at(table, k) for k in range(len(text) + 1)] == exact
        assert exact[token_counts.longest_prefix(table, 3)] <= 3
    for r in token_counts.prefix_token_counts(make(spark, texts), path).collect():
        text = dict(texts)[r.doc_id] or ""
        assert r.n_tokens == len(t.encode(text, add_special_tokens=False).ids) and r.n_bytes == len(text.encode())


def test_quality(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(40)) if k % 3 else "JUNK!! " * 30) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k, _ in rows] + [(1, None)], "doc_id long, quality int")
    docs = make(spark, [*rows, (900, None), (901, "")])
    scored = {r.doc_id: r for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert all(scored[k].predicted == int(k % 3 > 0) for k, _ in rows)
    assert scored[900].score == scored[901].score and scored[5].held_out == (zlib.crc32(b"5") % 5 == 0)
    assert quality.keep(docs, quality.fit(docs, labels.limit(0))).count() == 402


def test_licenses(spark, texts):
    said = [(100, "Licensed CC-BY, all rights\nreserved; GNU General Public License. ALL RIGHTS RESERVED"), (101, "Released under the MIT License."), (102, "the mit"), (103, None), (104, "Kelvin cc by")]
    rows = {r.doc_id: r for r in licenses.scan(make(spark, [*said, said[0]])).collect()}
    assert tuple(rows[100])[1:6] == (13, 4, 1, 10, "cc-by,gpl,reserved")
    assert rows[101].labels == "mit" and rows[102].labels == "" and rows[103].n_words == 0 and rows[104].n_base == 1
    assert licenses.scan(make(spark, [])).count() == 0


def test_substrings(spark, texts):
    docs = make(spark, texts)
    own = {}
    for k, text in sorted(texts, key=lambda r: r[0]):
        w = WORD.findall(text or "")
        for i in range(len(w) - 12):
            own.setdefault(tuple(w[i : i + 13]), k)
    spans = substrings.repeated_spans(docs)
    got = [tuple(r)[:4] for r in substrings.remove(docs, spans).collect()]
    want = []
    for k, text in texts:
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if own[tuple(w[i : i + 13])] < k:
                gone[i : i + 13] = [True] * 13
        want.append((k, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    assert sorted(got) == sorted(want)
    assert substrings.verified(docs, spans).where("not same").count() == 0


@pytest.mark.parametrize("partitions", [1, 2, 5])
def test_substrings_repeated_inside_a_document(spark, partitions):
    rng = random.Random(15)
    line = [f"l{k}" for k in range(30)]
    own = lambda k: [f"d{k}x{rng.randrange(10**6)}" for _ in range(20)]
    # the line stands once in 1, repeated in 2 and 3; 4 copies 2; each partition is a block of its own
    rows = {k: [*own(k), *line, *own(k), *(line * n), *own(k), *line[: 20 if n else 0]] for k, n in ((1, 0), (2, 2), (3, 3))}
    rows[4] = rows[2]
    rows[5] = [*line, *line[3:25], *own(5), *line]
    first, want = {}, []
    for k, w in rows.items():
        gone = set()
        for i in range(len(w) - 12):
            if first.setdefault(tuple(w[i : i + 13]), k) < k:
                gone.update(range(i, i + 13))
        want.append((k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    docs = spark.createDataFrame(spark.sparkContext.parallelize([(k, " ".join(rows[k])) for k in (3, 1, 5, 2, 4)], partitions), "doc_id long, text string")
    spans = substrings.repeated_spans(docs)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.remove(docs, spans).collect()]
    assert sorted(got) == want
    assert substrings.verified(docs, spans).where("not same").count() == 0


def test_chat(spark):
    ugly = "</s>[INST] ok [/INST] <|end|>\n<|user|>\n \\ \\\\< <\\| "
    rows = [(1, 0, "user", ugly), (1, 1, "assistant", ugly), (2, 0, None, None), (2, 0, "a|b|>", "x"), (3, 5, "assistant", "")]
    out = {r.conv_id: r for r in chat.conversations_of(chat.chains(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert out[1].n_turns == 2 and out[1].loss_chars == len(ugly) and out[1].loss_sha256 == hashlib.sha256(ugly.encode()).hexdigest()
    assert out[1].turns_sha256 == hashlib.sha256(f"user\n{ugly}\nassistant\n{ugly}\n".encode()).hexdigest()
    assert out[2].turns_sha256 == hashlib.sha256(b"\n\na|b|>\nx\n").hexdigest()
    tree = spark.createDataFrame([(7, 1, None, 1.0, "user", "q"), (7, 2, 1, 0.5, "assistant", "bad"), (7, 3, 1, 2.0, "assistant", "good"), (7, 4, 3, 0.1, "user", "more")], "conv_id long, node long, parent long, score double, role string, text string")
    best = chat.paths(tree, 1).orderBy("depth").collect()
    assert [r.node for r in best] == [1, 3, 4] and chat.paths(tree, None).select("leaf").distinct().count() == 2


def test_media(spark, texts, tmp_path):
    rows = media.recordings(make(spark, texts)).collect()
    for r in rows:
        raw = (dict(texts)[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (max(-(-len(raw) // 576), 1) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert len(r.log_mel) == media.BINS * media.MELS and media.samples_of(media.wav(payload)) == payload
    assert media.segments(np.array([0, 0, 9, 4, 9, 0, 0.0])) == [(2, 5)]
    assert media.recordings(make(spark, [])).count() == 0
    # stored and read again: tensors of one shape, and time spans within the recording
    media.tensor_blocks(make(spark, texts)).write.parquet(f"{tmp_path}/tensors")
    told, seen = {r.doc_id: r for r in rows}, 0
    for block in spark.read.parquet(f"{tmp_path}/tensors").collect():
        table = media.opened(block.arrow)
        mel = table["log_mel"].combine_chunks()
        assert mel.type.shape == [media.BINS, media.MELS] and table["bin_seconds"].type.shape == [media.BINS + 1] and len(table) == block.documents
        for k, doc_id in enumerate(table["doc_id"].to_pylist()):
            own, spans, seconds = told[doc_id], table["segments"][k].as_py(), table["bin_seconds"].combine_chunks().to_numpy_ndarray()[k]
            assert np.allclose(mel.to_numpy_ndarray()[k].ravel(), own.log_mel) and spans == own.segments
            assert (np.diff(seconds) >= 0).all() and all(0 <= a < b <= seconds[-1] + 1e-3 for a, b in spans)
            seen += 1
    assert seen == len(texts)


def test_resampling_and_bands_against_plain_sums():
    rng = np.random.default_rng(3)
    x = rng.normal(size=700).astype(np.float32)
    taps = np.zeros(media.TAPS.size, np.float64)
    for phase in range(media.UP):  # tap k of a phase multiplies the sample that many places back
        taps[phase :: media.UP] = media.TAPS[phase][::-1]
    width = media.TAPS.shape[1]
    stuffed = np.zeros(len(x) * media.UP)
    stuffed[:: media.UP] = x
    y = media.resampled(x)
    plain = np.array([sum(taps[k] * stuffed[n * media.DOWN - k] for k in range(len(taps)) if 0 <= n * media.DOWN - k < len(stuffed)) for n in range(len(y) - width)])
    assert np.allclose(plain, y[: len(plain)], atol=1e-4)
    tone = (128 + 100 * np.sin(2 * np.pi * np.arange(8000) * 0.05)).astype(np.uint8)
    assert len({int(k) for k in media.log_mel(tone)[2:-2].argmax(1)}) == 1


def test_secrets(spark):
    rng = random.Random(4)
    hexes = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(32))
    rows = [(k, " ".join([*(rng.choice("lorem ipsum dolor sit".split()) for _ in range(30)), f'token = "{hexes()}"' if k % 4 == 0 else "amet", "tail"])) for k in range(200)]
    rows += [(500, None), (501, ""), (502, "secret=token: abcdefg AKIA" + "A" * 16)]
    docs = make(spark, rows)
    field = secrets.fit(docs)
    out = {r.doc_id: r for r in secrets.scan(docs, field).collect()}
    assert all(out[k].n_assign == out[k].n_hex == int(k % 4 == 0) for k in range(200))
    assert (out[500].spans, out[502].n_assign, out[502].n_access) == ("", 0, 1)
    kept = {r.doc_id: r.text for r in secrets.mask(docs, field).collect()}
    assert "[assign]" in kept[0] and kept[500] is None and kept[1] == dict(rows)[1]
    # what decoding skips is outside on the best path too
    tokens = secrets.Tokens(__import__("pyarrow").array([x or "" for _, x in rows]))
    whole = [(a + i, a + j) for a, b in zip(tokens.words.first[:-1], tokens.words.first[1:]) if b > a for i, j in field.best(field.emissions(tokens.codes)[a:b], False, False)]
    assert whole == field.decode(tokens)


def test_secrets_that_no_pattern_finds(spark):
    rng = random.Random(21)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    filler = lambda: " ".join(rng.choice("lorem ipsum dolor sit amet mail.07@host3.example.org 2024 x1".split()) for _ in range(40))
    rows = [(k, f"{filler()} {'token = ' if k % 2 else ''}{hexes(40)} {filler()}" if k % 3 == 0 else filler()) for k in range(600)]
    field = secrets.fit(make(spark, rows))
    hidden = [(k, f"{filler()} {form} {filler()}") for k, form in enumerate([*(hexes(40).upper() for _ in range(60)), *(hexes(22) for _ in range(60))])]
    clean = [(1000 + k, filler()) for k in range(120)]
    out = {r.doc_id: r for r in secrets.scan(make(spark, [*hidden, *clean]), field).collect()}
    caught = sum(out[k].n_crf > 0 for k, _ in hidden)
    assert caught >= 108 and sum(out[k].n_crf for k, _ in clean) <= 2
    assert all(out[k].n_assign + out[k].n_access + out[k].n_hex == 0 for k, _ in hidden)


@pytest.mark.parametrize("seed", range(40))
def test_decoding_skips_nothing_of_the_best_path(seed):
    rng, words = np.random.default_rng(seed), random.Random(seed)
    field = secrets.Field()
    field.tables = [rng.normal(0, 3, t.shape) for t in field.tables]
    field.tables[0][:, secrets.OUT] += rng.uniform(0, 12)
    own = rng.normal(0, 1, (3, 3))
    own[secrets.OUT, secrets.INSIDE] = secrets.NEVER
    field.pairs = own
    texts = [" ".join("".join(words.choice("ab1.") for _ in range(words.randint(1, 9))) for _ in range(words.randint(0, 60))) for _ in range(60)]
    tokens = secrets.Tokens(__import__("pyarrow").array(texts))
    score = field.emissions(tokens.codes)
    whole = [(int(a) + i, int(a) + j) for a, b in zip(tokens.words.first[:-1], tokens.words.first[1:], strict=True) if b > a for i, j in field.best(score[a:b], False, False)]
    assert field.decode(tokens) == whole


def test_decontamination(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    item = [word() for _ in range(30)]
    edited = item[:7] + ["zz"] + item[8:15] + item[16:]
    filler = lambda: [word() for _ in range(20)]
    docs = make(spark, [(1, " ".join(filler() + item + filler())), (2, ", ".join(filler() + edited)), (3, " ".join(filler() + item[:12])), (4, None), (5, "short one")])
    items = spark.createDataFrame([(10, " ".join(item)), (10, " ".join(item)), (11, None), (12, "Short one")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.match(docs, items).collect()}
    assert set(got) == {(1, 10), (2, 10), (5, 12)} and got[1, 10].distance == 0 and got[2, 10].distance == 2
    assert (got[1, 10].first_word, got[1, 10].last_word) == (20, 49)
    assert {r.doc_id for r in decontaminate.clean(docs, items).collect()} == {3, 4}
    for _ in range(200):
        p, t = [rng.randrange(3) for _ in range(rng.randint(1, 9))], [rng.randrange(3) for _ in range(rng.randint(0, 12))]
        row = [0] * (len(t) + 1)
        for i in range(1, len(p) + 1):
            row, old = [i], row
            for j in range(1, len(t) + 1):
                row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (p[i - 1] != t[j - 1])))
        assert decontaminate.myers(p, t, 99)[0] == min([*row, len(p)])


def test_decontamination_by_items_that_are_short_or_without_id(spark):
    docs = make(spark, [(1, "a b c d e f, Short one! short one g h"), (2, "one short"), (3, " ".join(f"n{k}" for k in range(20))), (4, "p q r"), (5, "z"), (6, None)])
    items = spark.createDataFrame([(20, "short ONE"), (21, "e f short one"), (22, "h"), (23, "h one"), (24, "q r p"), (None, " ".join(f"n{k}" for k in range(3, 18))), (None, "z"), (25, "")], "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.match(docs, items).collect() if r.item_id is not None)
    assert got == [(1, 20, 0, 0, 6, 7), (1, 21, 0, 0, 4, 7), (1, 22, 0, 0, 11, 11)]
    assert sorted(r.doc_id for r in decontaminate.match(docs, items).where("item_id is null").collect()) == [3, 5]
    assert {r.doc_id for r in decontaminate.clean(docs, items).collect()} == {2, 4, 6}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(spark, texts, n, percent):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for k, text in texts:
        w = WORD.findall((text or "").translate(fold))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    up = {k: k for k in sets}

    def top(x):
        return x if up[x] == x else top(up[x])

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and top(a) != top(b):
            up[max(top(a), top(b))] = min(top(a), top(b))
    got = sorted(tuple(r) for r in ngram_join.near_duplicates(make(spark, texts), n, percent).collect())
    assert got == sorted((k, len(sets[k]), top(k)) for k, _ in texts)


def test_ngram_join_of_rows_with_one_id_or_none(spark):
    rng = random.Random(9)
    text = lambda: [f"x{rng.randrange(10**6)}" for _ in range(40)]
    a, b, c = text(), text(), text()
    near = lambda w: " ".join([*w, "more"])
    rows = [(1, " ".join(a)), (2, near(a)), (1, " ".join(b)), (3, near(b)), (None, " ".join(c)), (None, near(c)), (None, " ".join(text())), (9, near(c)), (9, near(c)), (None, None), (5, ""), (2**60 + 1, near(a))]
    got = [tuple(r) for r in ngram_join.near_duplicates(make(spark, rows), 3, 90).collect()]
    order = lambda rows: sorted(rows, key=str)
    assert order(got) == order([(1, 38, 1), (2, 39, 1), (1, 38, 1), (3, 39, 1), (None, 38, 9), (None, 39, 9), (None, 38, None), (9, 39, 9), (9, 39, 9), (None, 0, None), (5, 0, 5), (2**60 + 1, 39, 1)])
    kept = [(r.doc_id, r.text) for r in ngram_join.one_of_each(make(spark, rows), 3, 90).collect()]
    assert order(kept) == order([(1, rows[0][1]), (1, rows[2][1]), (None, rows[6][1]), (9, rows[7][1]), (None, None), (5, "")])
    assert ngram_join.near_duplicates(make(spark, [])).count() == 0 and ngram_join.one_of_each(make(spark, [])).count() == 0


def test_token_counts_of_long_units(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = [(0, "!" * 30_000 + "<|endoftext|>"), (1, "ab1é" * 20_000), (2, " " * 20_000 + "x"), (3, "漢字" * 70 + "<|endoftext|>" * 3), (4, "word" * 50_000), (5, None)]
    for r in token_counts.prefix_token_counts(make(spark, rows), path).collect():
        text = dict(rows)[r.doc_id] or ""
        assert r.n_tokens == len(t.encode(text, add_special_tokens=False).ids)
        for k in (1, 7, len(text) // 2):
            assert token_counts.tokens_at(r.prefix_changes, k) == len(t.encode(text[:k], add_special_tokens=False).ids)
    assert token_counts.prefix_token_counts(make(spark, []), path).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 200), (200, 100), (300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(51)}, 100: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(k, " ".join(word() for _ in range(60))) for k in range(40)] + [(k, "BAD!! " * 40) for k in range(40, 60)]
    rows += [(60, rows[3][1]), (61, rows[4][1] + " again"), (62, rows[5][1])]
    item = " ".join(word() for _ in range(30))
    rows.append((63, item + " " + rows[6][1]))
    spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, int(not t.startswith("BAD")), 0) for d, t in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert kept == set(range(40))
