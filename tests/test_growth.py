"""Work that must not grow faster than the tables: ranks by value, levels without parsing, places without Python, no needless shuffles."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from datassay import registry
from datassay.functions import cells, order
from datassay.operators import assoc, baseline


@pytest.mark.parametrize("few, hot", [(None, None), (0, 3)])
def test_ranks_of_pairs_come_from_counts(spark, few, hot):
    rng = np.random.default_rng(3)
    p = pd.DataFrame({"a": rng.integers(0, 40, 600).astype(float), "b": rng.integers(0, 3, 600).astype(float), "c": rng.normal(size=600).round(1)})
    p.loc[::7, "a"] = None
    p["g"] = np.where(p["c"] > 0, "up", "down")
    df = spark.createDataFrame(p).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "abc"], "g").repartition(5)
    got = {(r["a"], r["b"]): r for r in assoc.spearmans(df, [("a", "b"), ("c", "a"), ("c", "b")], few, hot).collect()}
    for (a, b), r in got.items():
        both = p[[a, b]].dropna()
        assert r["n"] == len(both) and r["rho"] == pytest.approx(both.rank().corr().iloc[0, 1], abs=1e-12)
    one = assoc.rank_etas(df, [("a", "g"), ("c", "g")], few, hot).collect()
    for r in one:
        own = p[[r["value"], "g"]].dropna()
        ranks = own[r["value"]].rank()
        m = ranks.mean()
        eta2 = sum(len(x) * (x.mean() - m) ** 2 for _, x in ranks.groupby(own["g"])) / ((ranks - m) ** 2).sum()
        assert (r["n"], r["k"]) == (len(own), 2) and r["h"] == pytest.approx((len(own) - 1) * eta2)


def test_typed_levels_are_not_parsed(spark):
    df = spark.createDataFrame([(0.04, 3, "A "), (float("nan"), None, "na"), (1e20, 1 << 60, "1.0"), (float("inf"), -7, None), (-0.0, 0, "x y")], "x double, i bigint, s string")
    for c in df.columns:
        cell = cells.to_cell(df, c)
        pairs = df.select(cells.level_key(df, c).alias("a"), F.when(~cells.is_missing(cell), cells.key(cell)).alias("b")).collect()
        assert [r["a"] for r in pairs] == [r["b"] for r in pairs]
    for c in ("x", "i"):
        assert "RLIKE" not in df.select(cells.level_key(df, c).alias("a"))._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("k", [2, 3, None])
def test_scores_of_columns_alone_need_no_gram_matrix(spark, monkeypatch, k):
    rows = [(i % 5, float(i * 7 % k) if k else float(i % 11), float(i % 13), float(i * 3 % 8), "abc"[i * 5 % 3]) for i in range(400)]
    df = spark.createDataFrame(rows, "fold int, datassay_y double, x double, d double, s string")
    fit = baseline.fit_folds(df, {"x": ("mean", False)}, {"d": False, "s": True}, [], 5, True)
    full, by = baseline.cross_validate(df, fit, k)
    none, alone = baseline.cross_validate(df, fit, k, whole=False)
    monkeypatch.setattr(baseline, "SPLIT_GRAMS", 0)
    other, _ = baseline.cross_validate(df, fit, k)
    assert none == [] and alone == by and np.allclose(full, other) and len(full) == 5


def test_places_are_found_without_python(spark, monkeypatch):
    from pyspark.sql.group import GroupedData

    monkeypatch.setattr(GroupedData, "applyInArrow", lambda *a: pytest.fail("a part was sorted in Python"))
    monkeypatch.setattr(order, "SLOT_ROWS", 50)
    n = {"a": [1 + i % 4 for i in range(700)], "b": [100_000, 1, 2]}
    nums = spark.createDataFrame([(c, float(i), m) for c, own in n.items() for i, m in enumerate(own)], "col string, num double, n bigint")
    places = {c: {str(i): i * (sum(own) - 1) // 40 for i in range(41)} for c, own in n.items()}
    got = order.select_places(nums, places)
    for c, own in n.items():
        values = np.repeat(np.arange(len(own)), own)
        assert got[c] == {k: float(values[at]) for k, at in places[c].items()}


def test_spearman_matrix_shuffles_no_rows(spark, sf, monkeypatch):
    from pyspark.sql import DataFrame

    monkeypatch.setattr(DataFrame, "repartition", lambda *a: pytest.fail("rows were shuffled"))
    assert registry.queries()["spearman_matrix"](spark, sf).count() == 6


def test_only_slash_dates_are_asked_for_their_parts(spark):
    from datassay.operators.temporal import temporal_columns

    rows = [("a", x, 1) for x in ("13/02/2020", "02/13/2020")] + [("b", x, 1) for x in ("13/02/2020", "14/02/2020")] + [("c", "2020", 1)]
    counts = spark.createDataFrame(rows, "col string, raw string, n int").withColumn("missing", F.lit(False)).withColumn("num", F.col("raw").try_cast("double"))
    out = temporal_columns(counts)
    assert {r["col"]: r["temporal"] for r in out.collect()} == {"a": False, "b": True, "c": False}
    assert "END AS p1#" in out._jdf.queryExecution().analyzed().toString()
