"""The one-pass baseline against fits by fold in numpy."""

import random
from collections import Counter

import numpy as np
import pytest

from datassay.operators import baseline, model


def table(n=400, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a = r.choice([None, r.gauss(0, 2), r.gauss(5, 1), 1.5])
        k = r.choice([None, *"abcde", *[f"z{j}" for j in range(30)]]) if r.random() < 0.7 else "a"
        cls = r.choice(["no", "yes", "yes", "maybe"]) if r.random() < 0.4 else "yes" if (a or 0) > 2 else "no"
        rows.append((i % 5, a, r.lognormvariate(0, 1) if r.random() < 0.9 else None, k, r.choice(["u", "v", None]), "x" if r.random() < 0.5 else None, cls, (a or 0.0) * 2 + (3 if k == "b" else 0) + r.gauss(0, 1)))
    return rows


NUMERIC, CATEGORICAL, PRESENCE = {"a": ("median", True), "b": ("mean", False)}, {"k": True, "m": False}, ["p"]
AT = {"fold": 0, "a": 1, "b": 2, "k": 3, "m": 4, "p": 5}


def features(train, rows, only=None):
    """The matrix of rows under what train says; only: one column, numbers in bins."""
    out = []
    for c, (how, flag) in NUMERIC.items():
        if only not in (None, c):
            continue
        own = sorted(x[AT[c]] for x in train if x[AT[c]] is not None)
        if only:
            edges = sorted({own[j * len(own) // 20] for j in range(1, 20)})
            at = [None if x[AT[c]] is None else sum(x[AT[c]] >= e for e in edges) for x in rows]
            out += [[float(v == j) for v in at] for j in range(len(edges) + 1)] + [[float(v is None) for v in at]]
            continue
        fill = float(np.median(own) if how == "median" else np.mean(own))
        filled = np.array([fill if x[AT[c]] is None else x[AT[c]] for x in train])
        out.append([((fill if x[AT[c]] is None else x[AT[c]]) - filled.mean()) / filled.std() for x in rows])
        if flag:
            out.append([float(x[AT[c]] is None) for x in rows])
    for c, flag in CATEGORICAL.items():
        if only not in (None, c):
            continue
        counts = sorted(Counter(x[AT[c]] for x in train if x[AT[c]] is not None).items(), key=lambda kv: (-kv[1], kv[0]))
        names = [k for k, _ in counts]
        kept = names if len(names) <= 20 else names[:19]
        level = [names[0] if x[AT[c]] is None else x[AT[c]] for x in rows]
        out += [[float(v == k) for v in level] for k in kept]
        if len(names) > 20:
            out.append([float(v not in kept) for v in level])
        if flag:
            out.append([float(x[AT[c]] is None) for x in rows])
    out += [[float(x[AT[c]] is None) for x in rows] for c in PRESENCE if only in (None, c)]
    return np.array(out).T


def ridge(x, y, w):
    mx, my = w @ x / w.sum(), w @ y / w.sum()
    z = x - mx
    b = np.linalg.solve(z.T @ (z * w[:, None]) + np.eye(x.shape[1]), z.T @ (w * (y - my)))
    return b, my - mx @ b


def expected(rows, classes, only=None):
    out = []
    for f in range(5):
        train, test = [r for r in rows if r[0] != f], [r for r in rows if r[0] == f]
        x, z = features(train, train, only), features(train, test, only)
        if classes:
            y, t = (np.array([classes.index(r[6]) for r in s]) for s in (train, test))
            n = np.bincount(y, minlength=len(classes))
            w = (len(y) / ((n > 0).sum() * n))[y]
            s = []
            for c in [1] if len(classes) == 2 else range(len(classes)):
                b, b0 = ridge(x, np.where(y == c, 1.0, -1.0), w)
                s.append(z @ b + b0)
            said = (s[0] > 0).astype(int) if len(classes) == 2 else np.argmax(s, 0)
            out.append(np.mean([(said[t == c] == c).mean() for c in sorted(set(t.tolist()))]))
        else:
            y, t = (np.array([r[7] for r in s]) for s in (train, test))
            b, b0 = ridge(x, y, np.ones(len(y)))
            out.append(1 - ((t - z @ b - b0) ** 2).sum() / ((t - t.mean()) ** 2).sum())
    return out


@pytest.mark.parametrize("goal", ["number", "two", "three"])
def test_scores_equal_fits_by_fold(spark, goal):
    rows = table()
    if goal == "two":
        rows = [(*r[:6], "yes" if r[6] == "maybe" else r[6], r[7]) for r in rows]
    classes = None if goal == "number" else sorted({r[6] for r in rows})
    y = lambda r: r[7] if classes is None else float(classes.index(r[6]))
    df = spark.createDataFrame([(*r[:6], y(r)) for r in rows], "fold int, a double, b double, k string, m string, p string, datassay_y double").repartition(3)
    fit = baseline.fit_folds(df, NUMERIC, CATEGORICAL, PRESENCE, 5, True)
    full, alone = baseline.cross_validate(df, fit, len(classes) if classes else None)
    assert np.allclose([s for s, _ in full], expected(rows, classes), atol=1e-8)
    for c in (*NUMERIC, *CATEGORICAL, *PRESENCE):
        assert np.allclose([s for s, _ in alone[c]], expected(rows, classes, c), atol=1e-8), c


def test_diagnose(spark):
    rows = table(300)
    df = spark.createDataFrame([(*r[1:6], r[6], r[7]) for r in rows], "a double, b double, k string, m string, p string, cls string, num double")
    for target, task in (("cls", "classification"), ("num", "regression")):
        got = model.diagnose(df, model.Plan(target, task, NUMERIC, CATEGORICAL, PRESENCE))
        assert got["status"] == "ok" and got["folds"] == 5 and got["rows"] == 300 and (got["signal"] or target == "cls")
        assert [c for c, _ in got["columns"]][0] in ("a", "k") and len(got["columns"]) == 5
    assert model.diagnose(df.limit(20), model.Plan("num", "regression", NUMERIC))["status"] == "unavailable"
    assert "classes" in model.diagnose(spark.range(1100).selectExpr("concat('c', id) as t", "id as x"), model.Plan("t", "classification", {"x": ("mean", False)}))["reason"]
