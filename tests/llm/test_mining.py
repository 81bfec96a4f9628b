"""Substring dedup, phrase mining and hard negatives against brute force, on odd inputs and at small limits."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from datassay.llm import hard_negatives, phrases, queries, substrings
from datassay.llm.fm import FmIndex
from datassay.llm.suffixes import intervals, shared_words, suffix_array, to_stop


def sequence(r, texts, sigma, most):
    return np.array([x for _ in range(texts) for x in [*(r.randint(1, sigma) for _ in range(r.randint(0, most))), 0]])


def suffix(ids, i):
    return tuple(ids[i : i + int(np.flatnonzero(ids[i:] == 0)[0])])


@pytest.mark.parametrize("sigma", [1, 2, 40])
def test_suffix_array_and_index(sigma):
    r = random.Random(sigma)
    ids = sequence(r, 40, sigma, 37)
    assert suffix_array(ids).tolist() == sorted(range(len(ids)), key=lambda i: (suffix(ids, i), i))
    order = suffix_array(ids, 3)
    assert order.tolist() == sorted(range(len(ids)), key=lambda i: (suffix(ids, i)[:3], i))
    left, shared = to_stop(ids), shared_words(ids, order, 3)
    for k in (1, 2, 3):
        first, times = intervals(ids, order, shared, k, left)
        got = dict(zip([suffix(ids, i)[:k] for i in first.tolist()], times.tolist()))
        assert got == Counter(s[:k] for i in range(len(ids)) if len(s := suffix(ids, i)) >= k)
    index = FmIndex(ids)
    for _ in range(60):
        s = list(suffix(ids, r.randrange(len(ids)))[: r.randint(1, 6)]) or [1]
        assert index.count(s) == sum(list(ids[i : i + len(s)]) == s for i in range(len(ids)))
    assert index.count([sigma + 1]) == 0
    other = sequence(r, 5, sigma + 1, 20)
    ends = np.flatnonzero(other == 0)
    begins = np.concatenate([[0], ends[:-1] + 1])
    text = {tuple(ids[i:j]) for i in range(len(ids)) for j in range(i + 1, min(i + 22, len(ids))) if 0 not in ids[i:j]}
    want = [max((m for m in range(2, e - b + 1) if tuple(other[e - m : e]) in text), default=0) for b, e in zip(begins, ends)]
    assert index.matches(other, begins, ends, 2).tolist() == want


def passages():
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared, line = say(30), say(7)
    rows = []
    for i in range(70):
        t = say(r.randint(0, 60))
        if i % 4 == 0:
            t += " " + shared + "\t" + say(r.randint(0, 9))
        if i % 9 == 0:
            t = "a b " * r.randint(3, 30) + t + "\n" + line + " x" * 40
        rows.append((i * 13 % 97, t, "z"))
    rows += [(500, None, "z"), (501, "", "z"), (502, " \n", None), (None, shared, "z"), (None, None, "z"), (503, shared.upper(), "z"), (504, say(4000) + " " + shared, "z"), (505, rows[0][1], "z")]
    return rows


def without_repeats(rows, width):
    seen, out = set(), {}
    for i, t, _ in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        w = (t or "").encode().split()
        gone = set()
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            gone.update(range(s, s + width) if k in seen else ())
            seen.add(k)
        out[i, t] = (len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode())
    return out


@pytest.mark.parametrize(("width", "gram", "hot", "shard"), [(20, 8, 4000, 400_000), (20, 8, 1, 300), (5, 2, 2, 200), (3, 2, 0, 100)])
def test_substring_dedup(spark, width, gram, hot, shard):
    rows = passages()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start string").repartition(5)
    # Null ids come last, one after the other by a hash: only one of them has words.
    want = without_repeats(rows, width)
    got = substrings.remove_repeats(df, width, gram=gram, hot=hot, shard_words=shard).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"], r["kept"]) for r in got) == sorted((i or -1, *x) for (i, _), x in want.items())


def test_substring_dedup_ids(spark):
    """Repeated rows are one document; other texts under the id are documents of their own; ids may be all unique."""
    text = " ".join(f"w{i}" for i in range(25))
    same = substrings.remove_repeats(spark.createDataFrame([(1, text), (1, text), (2, "x " + text)], "doc_id int, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in same) == [(1, 0), (1, 0), (2, 25)]
    other = substrings.remove_repeats(spark.createDataFrame([(1, text), (1, text + " y")], "doc_id int, text string")).collect()
    assert sorted(r["n_removed"] for r in other) == [0, 25]
    unique = substrings.remove_repeats(spark.createDataFrame([(7, text), (3, text)], "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["kept"]) for r in unique) == [(3, 0, text), (7, 25, "")]
    empty = substrings.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_words", "n_removed", "kept"]


def test_a_slice_may_end_anywhere():
    r = np.random.default_rng(1)
    h, doc = r.integers(0, 6, 3000).astype(np.uint64), np.sort(r.integers(0, 9, 3000))
    whole, parts = (substrings.cut(h, doc, 20, 8, most) for most in (1 << 24, 120))
    spread = lambda c: {(s + k, a) for s, n, a in zip(c[0].tolist(), c[1].tolist(), c[2].tolist()) for k in range(n)}
    assert spread(whole) == spread(parts)


def mined(rows, longest, least, top, num, den):
    f = defaultdict(Counter)
    table = {c: "|" for c in ".,;:!?\n\x0b\x0c\r"}
    for _, t, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).translate(str.maketrans(table))
        for piece in low.split("|"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            for n in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, own in f.items():
        total, rows_ = sum(c for p, c in own.items() if len(p) == 1), []
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in cand.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    inside[p[i : i + n]] = max(inside[p[i : i + n]], a)
        for p, a in cand.items():
            score, k = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            if not (p in inside and den * inside[p] >= num * a):
                rows_.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, total, -s) for i, (s, a, p, l, r) in enumerate(sorted(rows_)[:top])]
    return out


@pytest.mark.parametrize(("longest", "least", "top", "shard"), [(3, 10, 2000, 10_000), (3, 3, 15, 400), (4, 4, 2000, 900), (2, 2, 50, 100)])
def test_phrases(spark, longest, least, top, shard):
    r = random.Random(8)
    words = ["The", "cat", "sat", "on", "mat", "é", "x" * 50, "Ünder", "a-b"] + [f"r{i}" for i in range(30)]
    rows = []
    for i in range(120):
        w = [r.choice(words[:9] if r.random() < 0.7 else words) for _ in range(r.randint(0, 50))]
        rows.append((i, "".join(x + r.choice([" ", " ", " ", "  ", "\t", ", ", "\n", ".", " ? "]) for x in w), r.choice(["en", "de", None, "und"])))
    rows += [(900, None, "en"), (901, "", None), (902, " .. ,", "en"), (903, "cat sat " * 3000, "fr"), (903, "cat sat " * 30, "fr")]
    df = spark.createDataFrame(rows, "n bigint, text string, lang string").repartition(3)
    got = phrases.collocations(df, longest, least, top, shard_words=shard).collect()
    assert sorted(map(tuple, got)) == sorted(mined(rows, longest, least, top, 50, 100))
    assert phrases.collocations(df.limit(0)).count() == 0


def negatives(rows, positives, many, low, high):
    ok = [(i, l, [int(np.floor(256 * x)) for x in v]) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, l, v in ok:
        if i % 3:
            continue
        score = {j: sum(a * b for a, b in zip(v, w)) for j, _, w in ok if len(v) == len(w) and j != i}
        label = {j: m for j, m, _ in ok}
        best = sorted((j for j in score if label[j] == l), key=lambda j: (-score[j], j))[:positives]
        for p in best:
            good = [j for j in score if label[j] != l and low * score[p] <= 100 * score[j] <= high * score[p]]
            out += [(i, p, k + 1, j, score[p], score[j]) for k, j in enumerate(sorted(good, key=lambda j: (-score[j], j))[:many])]
    return out


@pytest.mark.parametrize(("bits", "block"), [(8, 4096), (2, 16), (1, 40)])
def test_hard_negatives(spark, bits, block):
    r = np.random.default_rng(4)
    centres = r.normal(size=(4, 12))
    rows = [(i, (centres[i % 4] * 0.3 + r.normal(size=12) * 0.4).tolist(), int(i % 4)) for i in range(150)]
    rows += [(300, None, 1), (301, [None] * 12, 1), (303, rows[0][1], None), (306, [float("nan")] * 12, 2), (309, [0.0] * 12, 0), (312, rows[3][1], 3), (315, [float("inf")] * 12, 2), (None, rows[3][1], 3), (318, rows[6][1], 2), (321, [1.0, 2.0], 1), (322, [0.9, 2.0], 1), (324, [0.5, 1.0], 2), (330, [], 2), (333, [3e6] * 12, 1), (334, [-2e6] * 12, 2)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(4)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 3 == 0, bits=bits, block=block).collect()
    assert sorted(map(tuple, got)) == sorted(negatives(rows, 5, 10, 30, 90))


def test_hard_negatives_odd_tables(spark):
    schema = "vec_id bigint, embedding array<float>, label int, score int"
    assert hard_negatives.hard_negatives(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    twice = [(1, [1.0, 0.0], 1, 0), (1, [1.0, 0.0], 1, 0), (2, [1.0, 0.5], 1, 0), (3, [0.5, 0.0], 2, 0), (3, [0.25, 0.0], 2, 0)]
    got = hard_negatives.hard_negatives(spark.createDataFrame(twice, schema), F.col("vec_id") == 1).collect()
    # The repeated row is one row; two rows under one id are two.
    assert sorted(map(tuple, got)) == [(1, 2, 1, 3, 65536, 32768)]
    huge = [(0, [1e300, 1.0], 1, 0), (1, [1e300, 0.0], 1, 0), (2, [8e299, 0.0], 2, 0)]
    got = hard_negatives.hard_negatives(spark.createDataFrame(huge, "vec_id bigint, embedding array<double>, label int, score int"), F.col("vec_id") == 0).collect()
    assert got == []  # both scores are held at 64 bits: the negative's is above the window


@pytest.mark.parametrize("held", [None, 0])
def test_hard_negatives_broadcast_no_table_by_its_file(spark, sf, monkeypatch, held):
    plans, write = [], hard_negatives.materialize
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(hard_negatives, "materialize", lambda df, name: (plans.append((name, plan(df))), write(df, name))[1])
    monkeypatch.setattr(hard_negatives, "HELD", hard_negatives.HELD if held is None else held)
    out = queries.queries()["op13_hard_negatives"](spark, sf)
    plans.append(("out", plan(out)))
    joins = {name: (p.count("BroadcastHashJoin"), p.count("SortMergeJoin")) for name, p in plans if "Join" in p}
    # Only the anchors' whole numbers, while they are few, go to all tasks.
    assert {name for name, (b, _) in joins.items() if b} == ({"positives", "out"} if held is None else set())
    assert {"anchors", "approximate", "positives", "near", "out"} <= set(joins) and max(b for b, _ in joins.values()) <= 1
    assert out.count() == 250


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, sf, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = db.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.fetchall())
