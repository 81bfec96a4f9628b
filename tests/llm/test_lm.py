"""The language model against a direct, recursive evaluation."""

import math
import random
import zlib
from collections import Counter

import pytest

from datassay.llm import lm

SCHEMA = "doc_id bigint, text string, n bigint"


def corpus():
    r = random.Random(3)
    words = ["the", "of", "and", "cat", "Dog", "ran", "é", "x1", "far", "away"] + [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(r.choices(words, weights, k=r.randint(0, 60))), 1) for i in range(160)]
    return docs + [(1000, None, 1), (1001, "", 1), (1002, " \t\n", 1), (1003, "never seen before the cat", 1), (docs[0][0], docs[0][1], 1), (None, "the the the", 1)]


def brute_base(docs):
    """(id, held, n_tokens, n_known, N, base), token by token."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: (t or "").encode().lower().split() + [b" "]
    c = Counter(w for i, t, _ in docs if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t, _ in docs]


def test_blocks_and_parts_do_not_change_scores(spark, monkeypatch):
    docs = corpus()
    df = spark.createDataFrame(docs, SCHEMA)
    one = {r[0]: r[6] for r in lm.katz_scores(df).collect()}
    two = {r[0]: r[6] for r in lm.katz_scores(df.repartition(7)).collect()}
    assert one.keys() == two.keys()
    assert all(one[k] == pytest.approx(two[k], abs=1e-9) for k in one)


def test_no_rows_and_no_training_rows(spark):
    assert lm.katz_scores(spark.createDataFrame([], SCHEMA)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = lm.katz_scores(spark.createDataFrame([(held, "a b", 1)], SCHEMA)).collect()
    assert rows[0]["n_tokens"] == 3 and rows[0]["train_tokens"] == 0 and math.isfinite(rows[0]["score"])


def test_keys_round_trip_as_planes():
    import numpy as np

    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    assert (lm.unplanes(lm.planes(keys)) == keys).all() and len(lm.unplanes(lm.planes(keys[:0]))) == 0
    cuts = lm.ranges(keys, 7)
    assert cuts[0] == 0 and cuts[-1] == len(keys) and (np.diff(cuts) > 500).all()


def brute_words(docs):
    """(id, score) by the recursion over trigrams of whole words."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: (t or "").encode().lower().split() + [b" "]
    c, c2, c3, x2, x3 = Counter(), Counter(), Counter(), Counter(), Counter()
    for i, t, _ in docs:
        if not held(i):
            u = v = "start"
            for w in tokens(t):
                c[w] += 1
                c2[v, w] += 1
                x2[v] += 1
                if v != "start":
                    c3[u, v, w] += 1
                    x3[u, v] += 1
                u, v = v, w
    n = sum(c.values()) + len(c) + 1
    d2, d3 = (lm.discounts([0] + [sum(k == r for k in x.values()) for r in range(1, lm.K + 2)]) for x in (c2, c3))
    d = lambda e, r: e[r] if r <= lm.K else 1
    after2, after3 = {}, {}
    for v, w in c2:
        after2.setdefault(v, []).append(w)
    for u, v, w in c3:
        after3.setdefault((u, v), []).append(w)

    def p2(v, w):
        if c2[v, w]:
            return d(d2, c2[v, w]) * c2[v, w] / (x2[v] + 1)
        own = after2.get(v, [])
        left = 1 - sum(d(d2, c2[v, y]) * c2[v, y] / (x2[v] + 1) for y in own)
        return left / (1 - sum((c[y] + 1) / n for y in own)) * (c[w] + 1) / n

    def p3(u, v, w):
        if v == "start":
            return p2(v, w)
        if c3[u, v, w]:
            return d(d3, c3[u, v, w]) * c3[u, v, w] / (x3[u, v] + 1)
        own = after3.get((u, v), [])
        left = 1 - sum(d(d3, c3[u, v, y]) * c3[u, v, y] / (x3[u, v] + 1) for y in own)
        return left / (1 - sum(p2(v, y) for y in own)) * p2(v, w)

    for u, v in list(x3)[:10]:
        reserved = p3(u, v, b"\0 no word")
        assert sum(p3(u, v, w) for w in c) + reserved == pytest.approx(1, abs=1e-9)
    out = []
    for i, t, _ in docs:
        u, v, score = "start", "start", 0.0
        for w in tokens(t):
            score += math.log10(p3(u, v, w))
            u, v = v, w
        out.append((i, score))
    return out


@pytest.mark.parametrize(("block", "part"), [(50, 40), (700, 400), (600_000, 1_200_000)])
def test_scores_equal_the_recursion(spark, monkeypatch, block, part):
    """Trigrams of all words, however rare, whatever the size of blocks and parts."""
    monkeypatch.setattr(lm, "BLOCK_TOKENS", block)
    monkeypatch.setattr(lm, "PART_TOKENS", part)
    docs = corpus()
    got = sorted(map(tuple, lm.katz_scores(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()), key=str)
    want = sorted((b + (s,) for b, (_, s) in zip(brute_base(docs), brute_words(docs))), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], abs=1e-8)


def test_a_very_long_text_and_clashing_columns(spark):
    docs = [(1, "a b c " * 40_000, 7), (2, "a b d", 8), (3, None, None)]
    got = {r["doc_id"]: r for r in lm.katz_scores(spark.createDataFrame(docs, "doc_id bigint, text string, score bigint")).collect()}
    assert got[1]["n_tokens"] == 120_001 and got[3]["n_tokens"] == 1
    base = {b[0]: b[5] for b in brute_base(docs)}
    assert all(got[i]["base_score"] == pytest.approx(base[i], rel=1e-9) for i in base)
