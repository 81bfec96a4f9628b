"""The plan's baseline and repeated values count in the verdict; the medcouple is that of all values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from datassay.functions import order
from datassay.operators import assoc, medcouple, stats
from datassay.operators import profile as P
from datassay.plans import analysis


@pytest.mark.parametrize("kind", ["noise", "signal", "perfect"])
def test_readiness_rests_on_the_plans_baseline(spark, kind):
    r = random.Random(7)
    rows = []
    for i in range(400):
        # In noise, every row has a twin with the other target.
        a, b = (r.randint(0, 60) / 3, r.randint(0, 60) / 7) if kind != "noise" or i % 2 == 0 else (rows[-1][0] + 1e-3, rows[-1][1])
        goal = {"noise": i % 2 == 0, "signal": a + r.gauss(0, 6) > 10, "perfect": 3 * a - 7 * b > 0}[kind]
        rows.append((a, b, "xyz"[i // 2 % 3], "yes" if goal else "no"))
    df = spark.createDataFrame(rows, "a double, b double, k string, goal string").repartition(2).persist()
    out = analysis.profile(df, "goal")
    found, said = out["baseline"].first(), {(x["level"], x["finding"]) for x in out["readiness"].collect()}
    assert found["status"] == "ok" and found["rows"] == df.count() - out["duplicates"].first()["duplicates"] and {c["col"] for c in found["columns"]} == {"a", "b", "k"}
    # What the model shows is in the verdict, and bounds the health.
    want = {"noise": ("fix", "a baseline finds no reliable signal"), "signal": ("note", "a baseline finds signal"), "perfect": ("blocker", "the baseline is nearly perfect")}[kind]
    assert want in said and ({x["verdict"] for x in out["readiness"].collect()} == {"blocked"}) == (kind == "perfect")
    assert out["health"].first()["score"] <= {"noise": 74, "signal": 100, "perfect": 70}[kind]
    again = analysis.diagnosed(df, out, "goal")
    assert again["status"] == "ok" and again["health"] == out["health"].first()["score"] and [c for c, _ in again["columns"]] == [c["col"] for c in found["columns"]]
    if kind != "noise":
        return
    without = analysis.profile(df, "goal", baseline=False)
    assert "baseline" not in without and want not in {(x["level"], x["finding"]) for x in without["readiness"].collect()}
    for t in ("plan", "recommendations"):
        assert sorted(without[t].collect()) == sorted(out[t].collect())


def test_repeated_values_that_give_the_target_are_told(spark):
    r = random.Random(3)
    goal = [r.random() < 0.5 for _ in range(80)]
    df = spark.createDataFrame([(f"p{i % 80}", r.random(), "yes" if goal[i % 80] else "no") for i in range(400)], "who string, x double, goal string")
    out = analysis.profile(df, "goal")
    told = [x["finding"] for x in out["readiness"].collect()]
    plan = {x["col"]: x["reason"] for x in out["plan"].collect()}
    leak = plan["who"] == "leak"
    assert [x["col"] for x in out["same_target"].collect()] == ["who"] and any(x.startswith("rows repeat by who") for x in told) != leak


def kernels(x):
    """The medcouple by all pairs."""
    z = np.sort(np.array(x, float)) - np.median(x)
    low, high, ties = z[z <= 0], z[z >= 0], int((z == 0).sum())
    i, j = np.indices((len(high), len(low)))
    top = high[:, None] - low[None]
    h = np.where(top == 0, np.sign(i + j - (len(low) - ties) - (ties - 1)), (high[:, None] + low[None]) / np.where(top == 0, 1, top))
    return float(np.median(h))


@pytest.mark.parametrize("slot", [None, 40])
def test_the_medcouple_is_that_of_all_values(spark, monkeypatch, slot):
    monkeypatch.setattr(order, "SLOT_ROWS", slot or order.SLOT_ROWS)
    r = np.random.default_rng(5)
    x = {"wide": np.exp(r.normal(size=1900)), "tied": r.integers(0, 9, 1801) ** 2.0, "even": np.arange(400) / 7, "left": -np.exp(r.normal(size=731) * 2), "flat": np.full(9, 3.0), "one": [5.0], "two": [1.0, 4.0], "half": [0.0] * 60 + [1.0] * 60, "most": [7.0] * 500 + r.normal(size=300).tolist(), "far": [-1.7e308, 1.0, 1.7e308, 1.6e308], "tiny": [0.0, 1e-300, 3e-300, 1e300]}
    # The tail of all values lies between the spaced ones.
    x["tail"] = np.concatenate([np.zeros(1500), 1 + np.arange(1499) / 1e3])
    rows = [(c, float(v), int(n)) for c, own in x.items() for v, n in zip(*np.unique(own, return_counts=True))]
    nums = spark.createDataFrame(rows, "col string, num double, n bigint").repartition(3).persist()
    got = medcouple.medcouples(nums, {c: float(np.median(own)) for c, own in x.items()}, {c: len(own) for c, own in x.items()})
    nums.unpersist()
    assert set(got) == set(x)
    for c, own in x.items():
        if c != "far":
            assert got[c] == pytest.approx(kernels(own), abs=1e-12), c
    assert -1 <= got["far"] <= 1


def test_counts_of_pairs_beyond_64_bits():
    a, b = np.array([1 << 40, 3, 1 << 41]), np.array([(1 << 42) + 5, 7, (1 << 43) - 1])
    assert medcouple.product_sum(a, b) == sum(int(x) * int(y) for x, y in zip(a, b))
    u, l = np.array([1.0, 2.0, 2.0]), np.array([1.0, 3.0])
    assert [medcouple.selected(u, np.array([1, 2, 1]), l, np.array([3, 1]), k) for k in range(16)] == sorted([1 / 3] + [1.0] * 3 + [2 / 3] * 3 + [2.0] * 9)


def test_statistics_take_all_values_unless_told(spark):
    x = np.sort(np.concatenate([np.arange(1600) * 1.0, np.exp(np.arange(900) / 90)]).round(3))
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    full, spaced = (stats.statistics(P.value_counts(df), most=m).first()["mc"] for m in (None, 1500))
    assert full == pytest.approx(kernels(x), abs=1e-12) and spaced != full


def test_pairs_of_many_columns(spark, monkeypatch):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 6)) @ r.normal(size=(6, 6)) + 1e6
    df = spark.createDataFrame([tuple(None if (i + j) % 11 == 0 else float(v) for j, v in enumerate(row)) for i, row in enumerate(x)], "a double, `b.c` double, d double, e double, f double, g double").repartition(3)
    few = {(t["a"], t["b"]): (t["n"], t["r"]) for t in assoc.pearson_pairs(df, df.columns).collect()}
    monkeypatch.setattr(assoc, "PAIRS", 3)
    many = {(t["a"], t["b"]): (t["n"], t["r"]) for t in assoc.pearson_pairs(df, df.columns).collect()}
    assert len(few) == 15 and set(many) == set(few) and all(many[k] == (few[k][0], pytest.approx(few[k][1], abs=1e-9)) for k in few)


def test_the_matrix_has_all_columns(spark):
    columns = [f"v{i}" for i in range(42)]
    df = spark.range(60).select(*[F.sin(F.col("id") * (i + 1) * 0.7).alias(c) for i, c in enumerate(columns)])
    out = analysis.profile(df)
    assert {r["role"] for r in out["profile"].collect()} == {"numeric"} and out["matrix"].count() == 42 * 41 // 2
