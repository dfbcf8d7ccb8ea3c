"""Text operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import functools
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from knnspark.llm import jaccard, katz, packing, piece_codec, quality, suffix_dedup
from knnspark.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, ranges string, n int, rk long, key string, t long"


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def make(seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = prose(60)
    texts = [None, "", "  \n ", "one", "One two", "one two", "a\tb\nC  d", "x" * 500, "ab" * 400, prose(6000)]
    base = prose(150)
    for _ in range(40):  # near copies
        w = base.split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [base] * 5
    texts += [prose(30) + " " + passage + " " + prose(30) for _ in range(12)]
    texts += [prose(rng.randint(3, 80)) for _ in range(40)]
    return list(enumerate(texts)) + [(7, "x" * 500), (3, "one")]


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "c", 1, 2, "k", 3) for i, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def groups(rows, k, percent):
    sets = collections.defaultdict(list)
    for i, t in rows:
        w = words_of(t)
        sets[i].append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, sets


@pytest.mark.parametrize(("k", "percent", "dense", "direct"), [(3, 90, 4, 3), (5, 80, 1000, 250)])
def test_jaccard(docs, rows, k, percent, dense, direct):
    want, sets = groups(rows, k, percent)
    got = jaccard.near_duplicates(docs, k, percent, dense, direct).collect()
    assert len(got) == len(rows)
    assert all(r.component_id == want[r.doc_id] and r.n_shingles in {len(s) for s in sets[r.doc_id]} for r in got)


def test_jaccard_large_group_of_near_copies_takes_several_rounds(spark, monkeypatch):
    """Copies of copies, so that one pivot doesn't link with all; ids are strings and some repeat with another text."""
    random = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [random.choice(vocabulary, 120)]
    for _ in range(90):
        t = texts[random.integers(len(texts))].copy()
        t[random.integers(0, 120, random.integers(1, 4))] = random.choice(vocabulary)
        texts.append(t)
    rows = [(f"d{i % 86:03}", " ".join(t)) for i, t in enumerate(texts)]
    want, _ = groups(rows, 3, 90)
    rounds = []
    differ = jaccard._differ
    monkeypatch.setattr(jaccard, "_differ", lambda orders: rounds.append(1) or differ(orders))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string").repartition(3), dense=30, direct=9).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(rounds) >= 3 and 1 < len(set(want.values())) < 80


def test_jaccard_empty_and_null_ids(spark, none):
    assert jaccard.near_duplicates(none).count() == 0
    got = jaccard.near_duplicates(spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "a b c")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 0), (1, 1)]


@pytest.mark.parametrize("dense", [2, 256])
def test_suffix_dedup(docs, rows, dense):
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    want = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for j in range(len(t) - 199):
            if seen[t[j : j + 200]] > 1:
                gone[j : j + 200] = True
        want.append((i, len(t), int(gone.sum()), bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    got = [(r.doc_id, r.n_bytes, sum(x.b - x.a for x in r.removed), bytes(r.kept)) for r in suffix_dedup.dedup(docs, 200, dense).collect()]
    assert sorted(got) == sorted(want)
    assert sum(w[2] for w in want) > 5000


def test_suffix_dedup_empty(none):
    assert suffix_dedup.dedup(none).count() == 0


def test_deep_shallow_sorts():
    rng = random.Random(2)
    for _ in range(100):
        texts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 30))]
        texts += [t + b"a" for t in texts[:5]] + texts[:3]
        order, common = suffix_dedup.deep_shallow(texts, 16)
        ordered = [texts[i] for i in order]
        assert ordered == sorted(texts)
        assert all(common[i] == suffix_dedup.common_prefix(ordered[i - 1], ordered[i]) for i in range(1, len(texts)))


def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    ids = collections.defaultdict(list)
    for i, text in rows:
        ids[i].append([*t.encode(text or "", add_special_tokens=False).ids, 2])
    got = packing.pack_documents(docs, path, 2, 128).collect()
    filled = collections.defaultdict(list)
    for r in got:
        assert any(r.ids_crc32 == zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) for x in ids[r.doc_id])
        assert r.length == 128 or r.piece == 0
        filled[r.sequence_id].append((r.offset, r.length))
    for spans in filled.values():
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at <= 128
    total = sum(len(x) for xs in ids.values() for x in xs)
    assert sum(r.length for r in got) == total
    assert len(filled) <= math.ceil(total / 128) * 1.02 + 1
    assert packing.pack_documents(none, path).count() == 0


def test_token_ids_equal_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab 'sé\n\t1日\u00a0.!<|>") for _ in range(200)) for _ in range(200)] + ["<|endoftext|> a", "a <|endoftext|>b<|endoftext|>", "it's we'll", " "]
    for text, got in zip(texts, packing.encoder(path).encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_solver_holds_every_item():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 2000):
        h = np.bincount(rng.integers(1, 65, n), minlength=65)
        packing_ = packing.solve(h)
        held = np.zeros(65, int)
        for c, times in packing_.plan:
            assert sum(x * m for x, m in c) <= 64
            for x, m in c:
                held[x] += m * times
        assert (held == h).all()
        assert packing_.sequences >= packing_.bound


def test_program_carries_the_packing():
    """Prices prove a bound that the fractional solution is near; most items are placed by it, in little over the fewest sequences."""
    rng = np.random.default_rng(4)
    h = np.bincount(rng.integers(5, 257, 20000), minlength=257)
    solution = packing.solve_program(np.append(h[:256], 0), rounds=500, step=0.2)
    assert solution.bound <= solution.value <= 1.1 * solution.bound
    packing_ = packing.solve(h)
    assert packing_.by_program >= 0.85 * h[:256].sum()
    filled = packing.solve(h, rest=1.0)  # no program: best fit alone
    assert filled.by_program == 0
    assert packing_.sequences <= 1.006 * filled.sequences


def test_knapsack_against_all_multisets():
    rng = np.random.default_rng(6)
    value, most = np.append(0, rng.random(12)), np.append(0, rng.integers(0, 3, 12))
    best = [0.0] * 13
    for picks in itertools.product(*(range(m + 1) for m in most[1:])):
        size = sum(n * (i + 1) for i, n in enumerate(picks))
        for cap in range(size, 13):
            best[cap] = max(best[cap], sum(n * value[i + 1] for i, n in enumerate(picks)))
    knapsack = packing.Knapsack(value, most)
    assert knapsack.best == pytest.approx(best)
    for cap, held in enumerate(knapsack.configurations(np.arange(13))):
        assert sum(x * n for x, n in held.items()) <= cap
        assert all(n <= most[x] for x, n in held.items())
        assert sum(value[x] * n for x, n in held.items()) == pytest.approx(best[cap])


def good_turing(counts):
    """r* = (r + 1) n(r+1) / n(r), freed mass rescaled so that counts above five keep theirs; half a count where that has no value."""
    n = collections.Counter(counts)
    past = 6 * n[6] / n[1] if n[1] else 0
    share = {}
    for r in range(1, 6):
        ratio = ((r + 1) * n[r + 1] / n[r] / r - past) / (1 - past) if n[r] and past < 1 else 0
        share[r] = ratio if 0 < ratio < 1 else 1 - 0.5 / r
    return lambda r: r * share.get(r, 1)


@pytest.mark.parametrize("order", [2, 3])
def test_katz(docs, rows, none, monkeypatch, order):
    monkeypatch.setattr(katz, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(katz, "PART_TOKENS", 400)
    tokens = [(i, [*words_of(t), None]) for i, t in rows]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0

    def grams(t, m):
        t = [*["begin"] * (m - 1), *t]
        return [tuple(t[i : i + m]) for i in range(len(t) - m + 1)]

    counts = {m: collections.Counter(g for i, t in tokens if not held(i) for g in grams(t, m)) for m in range(1, order + 1)}
    cut = {m: good_turing(c.values()) for m, c in counts.items()}
    n = sum(counts[1].values())
    kept = sum(cut[1](r) for r in counts[1].values())
    unknown = 1 - kept / n
    follow = {m: collections.defaultdict(list) for m in counts}
    for m, c in counts.items():
        for g in c:
            follow[m][g[:-1]].append(g[-1])

    @functools.cache
    def context(c):
        m = len(c) + 1
        r = [counts[m][*c, w] for w in follow[m][c]]
        mass, whole = sum(map(cut[m], r)), sum(r)
        whole += mass >= whole
        return whole, (1 - mass / whole) / (1 - sum(p(c[1:], w) for w in follow[m][c]))

    @functools.cache
    def p(c, w):
        m = len(c) + 1
        if m == 1:
            return cut[1](counts[1][w,]) / n if counts[1][w,] else unknown
        if counts[m][*c, w]:
            return cut[m](counts[m][*c, w]) / context(c)[0]
        return p(c[1:], w) * (context(c)[1] if c in follow[m] else 1)

    for c in list(follow[order])[:20]:
        assert sum(p(c, w) for (w,) in counts[1]) + p(c, "never seen") == pytest.approx(1)
    want = []
    for i, t in tokens:
        base = sum(math.log10((counts[1][w,] + 0.1) / (n + 0.1 * (len(counts[1]) + 1))) for w in t)
        want.append((i, held(i), len(t), sum(counts[1][w,] > 0 for w in t), n, base, sum(math.log10(p(g[:-1], g[-1])) for g in grams(t, order))))
    got = [tuple(r) for r in katz.score_texts(docs, order).collect()]
    assert len(got) == len(want)
    for x, y in zip(sorted(got), sorted(want), strict=True):
        assert x[:5] == y[:5] and x[5] == pytest.approx(y[5]) and x[6] == pytest.approx(y[6])
    assert katz.score_texts(none, order).count() == 0


def test_piece_codec(docs, rows, none):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted((i, model.encode(t or ""), t or "") for i, t in rows)
    got = sorted((r.doc_id, list(r.ids), r.decoded) for r in piece_codec.encode(docs, path).collect())
    assert got == want
    assert piece_codec.encode(none, path).count() == 0


def test_piece_codec_odd_texts():
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(6)
    texts = ["", " ", "  two  spaces ", "a\n\nb\tc", "日本語 🤗 naïve", "x" * 700, " " * 90 + "y", "\0 \0a"]
    texts += ["".join(rng.choice("the ionéz\n▁😀\0") for _ in range(rng.randint(1, 600))) for _ in range(60)]
    for text, ids in zip(texts, piece_codec.vocabulary(path).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(text)


def test_quality(spark, none):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    clean = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(30, 200))) + "." for _ in range(200)]
    junk = [" ".join(x + "$$$" for x in t.split()) for t in clean[:15]] + [" ".join([x] * 12) for x in vocabulary[:15]] + [t.upper().replace(" ", "!! ") for t in clean[15:30]]
    rows = list(enumerate([*clean, *junk, None, "", clean[0]]))
    docs = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, quality string")
    model = quality.fit(docs, 100)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(got) == len(rows) and got[0].quality == "q"
    kept = {i: r[quality.QUALITY].kept for i, r in got.items()}
    assert all(kept[i] for i in range(200))
    assert sum(not kept[i] for i in range(200, 245)) >= 43
    assert kept[245] and kept[246] and got[0][quality.QUALITY].score == got[247][quality.QUALITY].score
    assert quality.classify(none).count() == 0


def test_digest_of_hash_is_stable():
    assert hashlib.sha256(jaccard.signature(np.array([1, 2], np.uint64))).hexdigest() == hashlib.sha256(jaccard.signature(np.array([2, 1], np.uint64))).hexdigest()


def test_wanted_texts_take_no_second_worker(spark, monkeypatch):
    """The bit test of a text's id runs where its set is made; a UDF beside it doubled the Python workers of each executor."""
    from knnspark.llm import jaccard

    def udf(*_):
        raise AssertionError("a Python UDF beside the set maker")

    monkeypatch.setattr(jaccard, "may_hold", udf)
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(100 + i, t + " more") for i, t in enumerate(texts[:10])] + [(200, texts[3]), (201, None)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert got == {i: i for i in range(30)} | {100 + i: i for i in range(10)} | {200: 3, 201: 201}
