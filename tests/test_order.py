"""Directories, selection, ranks and the Spearman matrix on small slots, against sorts and plain ranks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from datassay.functions import order
from datassay.operators import assoc, prep, relations, stats


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(order, "SLOT_ROWS", 40)
    monkeypatch.setattr(order, "FAN", 6)
    monkeypatch.setattr(order, "COMPARED", 5)


def values(n, seed=1):
    r = random.Random(seed)
    return [r.choice([r.gauss(0, 1), float(round(r.gauss(0, 3))), 7.0, r.lognormvariate(0, 4), -1e12]) for _ in range(n)]


def ranks(x):
    x = np.array(x)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def test_slots_follow_rows(spark, small):
    """Beyond the first level's slots, cuts go on: no slot holds more than a few times SLOT_ROWS distinct values."""
    x = [float(v) for v in np.random.default_rng(2).normal(size=6000)]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    d = order.directory(df, F.col("x"))
    assert len(d.cuts) > 6000 / 40 * 0.6
    got = df.groupBy(d.slot(F.col("x")).alias("s")).count().collect()
    assert len(got) == len(d.cuts) + 1 and max(r["count"] for r in got) < 40 * 5
    nums = df.select(F.lit("a").alias("col"), F.col("x").alias("num"), F.lit(1).alias("n"))
    cuts = order.directories(nums, order.sizes(nums))["a"]
    assert len(cuts) > 6000 / 40 * 0.6


def test_selection(spark, small):
    data = {"a": values(3000), "b": [3.0] * 500, "c": [float(i) for i in range(1500)], "d": [5.0]}
    nums = spark.createDataFrame([(c, v) for c, x in data.items() for v in x], "col string, num double").groupBy("col", "num").agg(F.count("*").alias("n"))
    places = {c: {str(i): i for i in {0, 1, len(x) // 3, len(x) // 2, len(x) - 1}} | {"out": len(x)} for c, x in data.items()}
    got = order.select_places(nums, places)
    assert got == {c: {k: sorted(data[c])[i] for k, i in p.items() if i < len(data[c])} for c, p in places.items()}
    every = order.select_places(nums, {"a": {str(i): i for i in range(3000)}})["a"]
    assert [every[str(i)] for i in range(3000)] == sorted(data["a"])
    q = {r["col"]: r for r in stats.quantiles(nums, {"q1": 0.25, "m": 0.5, "top": 0.99}).collect()}
    for c, x in data.items():
        assert np.allclose([q[c]["q1"], q[c]["m"], q[c]["top"]], np.quantile(x, [0.25, 0.5, 0.99]), rtol=1e-12)
    assert stats.quantiles(nums.limit(0), {"q1": 0.25}).count() == 0


def test_ordinals_and_folds(spark, small):
    x = values(2000, 3)
    df = spark.createDataFrame([(v, i) for i, v in enumerate(x)] + [(None, -1)], "x double, i int").repartition(5)
    got = order.ordinals(df, F.col("x"), F.col("i")).collect()
    assert [r["i"] for r in sorted(got, key=lambda r: r["rn"])] == [i for _, i in sorted((v, i) for i, v in enumerate(x))]
    assert sorted(r["rn"] for r in got) == list(range(1, 2001)) and {r["rows"] for r in got} == {2000}
    folds = prep.stratified_folds(df.where("x is not null").withColumn("t", F.when(F.col("x") > 0, "p").otherwise("n")), "t", F.col("i"), 5)
    by = folds.groupBy("t", "fold").count().collect()
    for t in "pn":
        own = [r["count"] for r in by if r["t"] == t]
        assert len(own) == 5 and max(own) - min(own) <= 1


@pytest.mark.parametrize("held", [0, 2_000_000])
def test_spearman_matrix(spark, small, held):
    """The rank correlation of a and a monotone function of it is 1, however rows are dealt; gaps and repeated rows count."""
    r = random.Random(9)
    rows = [(a := r.uniform(-2, 2), a**3 if a > -1 else None, float(r.randint(0, 3)), None if r.random() < 0.3 else a + r.gauss(0, 1)) for _ in range(600)]
    rows += rows[:50] + [(None, None, None, None)]
    names = ["a", "cube", "few levels", "noisy"]
    df = spark.createDataFrame(rows, "a double, cube double, `few levels` double, noisy double").repartition(8)
    got = {(x["a"], x["b"]): (x["n"], x["rho"]) for x in relations.spearman_matrix(df, names, held=held).collect()}
    columns = [[row[i] for row in rows] for i in range(4)]
    own = [dict(zip([k for k, v in enumerate(c) if v is not None], ranks([v for v in c if v is not None]))) for c in columns]
    for i in range(4):
        for j in range(i + 1, 4):
            both = sorted(own[i].keys() & own[j].keys())
            want = np.corrcoef([own[i][k] for k in both], [own[j][k] for k in both])[0, 1]
            assert got[names[i], names[j]][0] == len(both) and abs(got[names[i], names[j]][1] - want) < 1e-9
    pair = spark.createDataFrame([(float(i), float(i * i)) for i in range(2000)], "a double, b double").repartition(8)
    assert relations.spearman_matrix(pair, ["a", "b"], held=held).first()["rho"] == pytest.approx(1.0)
    assert assoc.spearman(pair, "a", "b").first()["rho"] == pytest.approx(1.0)
    assert [x["rho"] for x in relations.spearman_matrix(df.limit(0), names, held=held).collect()] in ([], [0.0] * 6)
