"""Operators on pairs, and the searches, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from datassay.llm import ann, jaccard, neardup
from datassay.llm.components import components


def reach(ids, links):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


@pytest.mark.parametrize("one_task", [0, 10_000])
def test_components(spark, one_task):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint").repartition(5), one_task=one_task).collect()))
    ids = {x for l in links for x in l}
    want = reach(ids, links)
    assert all(got.get(i, i) == want[i] for i in ids)
    assert components(spark.createDataFrame([], "a bigint, b bigint"), one_task=one_task).count() == 0


def texts():
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows, passage = [], [r.choice(words) for _ in range(40)]
    for i in range(60):
        base = [r.choice(words) for _ in range(r.randint(1, 120))]
        if i % 3 == 0:
            base[len(base) // 2 : len(base) // 2] = passage
        rows.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            other = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                other[r.randrange(len(other))] = r.choice(words)
            rows.append("  ".join(other).upper() if r.random() < 0.3 else " ".join(other))
    rows += [None, "", " \n\t", "one two", "ONE two", "one two three four five", rows[0], rows[0]]
    return [(i * 7 % 1000, t, "x") for i, t in enumerate(rows)]


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 80, 100), (1, 60, 100)])
def test_jaccard_join(spark, n, num, den):
    rows = texts()
    sets = {}
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        m = min(n, len(w))
        sets[i] = {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if w else set()
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = reach(ids, links)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n bigint".replace("n bigint", "k1 string")).repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(df, n, num, den).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in ids}
    assert len(links) > 20


def test_jaccard_join_empty_table_and_null_id(spark):
    assert jaccard.jaccard_join(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    rows = jaccard.jaccard_join(spark.createDataFrame([(None, "a b c d"), (1, "a b c d")], "doc_id bigint, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in rows} == {(None, None), (1, 1)}


def test_overlap_blocks_agree_with_sets():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 1 << 63, k).astype(np.uint64)) for k in (50, 400, 1, 0)]
    sets += [np.unique(np.append(sets[1][:380], sets[0][:5])), sets[1]]
    pairs = np.array([(i, j) for i in range(6) for j in range(i)])
    for block in (16, 1 << 14):
        got = jaccard.overlap_counts(sets, pairs, 85, 100, block)
        want = [len(sets[i]) > 0 and len(sets[j]) > 0 and 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j])) for i, j in pairs]
        assert got.tolist() == want


def vectors(n, dims, seed):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, dims))
    for i in range(0, n, 3):
        base[i] = base[i // 10 * 10] * r.uniform(0.5, 2) + r.normal(size=dims) * r.choice([0.02, 0.1, 0.16, 0.2])
    return base.astype(np.float32)


@pytest.mark.parametrize("tile", [16, 512])
def test_embedding_near_duplicates(spark, tile):
    x = vectors(240, 24, 3)
    rows = [(i, [float(v) for v in x[i]], int(i % 3 if i % 10 else 1)) for i in range(240)]
    rows += [(300, rows[0][1], rows[0][2]), (301, rows[0][1], rows[0][2]), (302, None, 1), (303, [0.0] * 24, 1), (304, [float("nan")] + [1.0] * 23, 1), (305, [None] + [1.0] * 23, 1), (306, rows[5][1], None), (307, [1.0, 2.0], 1), (308, [2.0, 4.0], 1)]
    ok = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v, l in rows if v and l is not None and all(e is not None and np.isfinite(e) for e in v) and any(v)}
    label = {i: l for i, _, l in rows}
    links = [(a, b) for a in ok for b in ok if a < b and label[a] == label[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= 0.98]
    assert len(links) > 30
    want = reach([r[0] for r in rows], links)
    count = {i: sum(i in l for l in links) for i in want}
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, tile=tile).collect()}
    assert got == {i: (count[i], want[i], want[i] == i) for i in want}
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_quantised_bound_is_rigorous():
    x = neardup.unit_rows(list(vectors(200, 32, 8)))
    q, s, e = neardup.quantise(x)
    near = (q.astype(float) @ q.astype(float).T) * s[:, None] * s[None]
    assert (np.abs(near - x @ x.T) <= e[:, None] + e[None] + e[:, None] * e[None]).all()
    for threshold in (0.98, 0.6, float(x[0] @ x[1])):
        sure, unsure = neardup.judge_pairs(neardup.refine(x), neardup.refine(x), True, threshold)
        want = np.triu(x @ x.T >= threshold, 1)
        assert not (sure & ~want).any() and not (want & ~sure & ~unsure).any() and unsure.sum() <= 20
    # Rows whose codes leave nothing over.
    assert (neardup.refine(np.eye(3))[1][2] <= 1e-11).all()


def test_nearest_neighbours(spark):
    x = vectors(900, 16, 4)
    x[100:140] = x[100]
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(900)] + [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(4)
    got: dict = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    y = x.astype(float)
    assert sorted(got) == list(range(0, 900, 20))
    hits = 0
    for q, found in got.items():
        s = y @ y[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(900), -s))[:20]
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        assert all(abs(score - y[q] @ y[v]) < 1e-9 and v != q for _, v, score in found)
        hits += len(set(best) & {v for _, v, _ in found})
    assert hits / (20 * len(got)) >= 0.9


@pytest.mark.parametrize("times", [3000, 1e7])
def test_one_long_vector_does_not_erase_the_others(spark, times):
    x = vectors(600, 16, 9).astype(float)
    x[1] *= times
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(600)], "vec_id bigint, embedding array<double>").repartition(4)
    got: dict = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=20).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 600, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & got[q])
    assert hits / (20 * 30) >= 0.9


def test_nearest_with_fewer_candidates_than_k(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 1.0])], "vec_id bigint, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect()}
    assert got == {(0, 1): 20, (0, 2): 1, (20, 1): 0, (20, 2): 1}
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_tile_forest_connects_what_links_connect():
    r = np.random.default_rng(6)
    m = np.triu(r.random((60, 60)) < 0.03, 1)
    m |= m.T
    i, j = neardup.forest(m)
    assert len(i) < 60 and m[i, j].all()
    assert reach(range(60), zip(i.tolist(), j.tolist())) == reach(range(60), np.argwhere(m).tolist())
    assert len(neardup.forest(np.zeros((3, 3), bool))[0]) == 0


def test_embedding_near_duplicates_in_clusters_and_repeated_ids(spark):
    """Many sure links in few tiles, pairs near the threshold, an id with two vectors, and columns with the operator's names."""
    r = np.random.default_rng(9)
    x = np.repeat(r.normal(size=(3, 20)), 70, axis=0) + r.normal(size=(210, 20)) * np.tile([0.02, 0.1, 0.14], 70)[:, None]
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(210)] + [(4, [float(v) for v in -x[4]], 1), (500, [float(v) for v in -x[4]], 1)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.98
    links = np.argwhere(np.triu(near, 1)).tolist()
    want, count = reach(range(210), links), near.sum(1) - 1
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").selectExpr("*", "1 as rep", "2 as size", "3 as tile", "4 as kind").repartition(5)
    got = {(r["vec_id"], r["n_links"], r["component_id"]) for r in neardup.near_duplicates(df, tile=32).collect()}
    assert len(links) > 1000
    assert got == {(i, int(count[i]), want[i]) for i in range(210)} | {(4, 1, want[4]), (500, 1, want[4])}
