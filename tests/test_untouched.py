"""Known answers for functions that no query calls by itself: cards, verdicts, proxies, samples, reports, accounts."""

import json

import pytest
from pyspark.sql import functions as F

from datassay.operators import accounts, advice, claims, cleaning, compare, relations, sampling
from datassay.operators import profile as P
from datassay.plans import analysis
from datassay.sources import exports, sample


def column(c, role, distinct, missing=0, rows=1000):
    return {"col": c, "role": role, "rows": rows, "missing": missing, "present": rows - missing, "distinct_raw": distinct}


def test_insight_cards():
    profile = [column("t", "binary", 2), column("gap", "numeric", 90, 600), column("some", "numeric", 90, 100), column("flat", "categorical", 1), column("day", "temporal", 300), *[column(c, "numeric", 500) for c in "abcd"]]
    stats = [{"col": "a", "outliers": 40, "kurtosis": 9.0}, {"col": "b", "outliers": 0, "kurtosis": 0.1}]
    cards = advice.insights(profile, ["leak"], 7, "t", stats, [("a", "b", 0.95), ("c", "d", 0.8)], [{"col": "a", "abs_value": 0.2}], [{"label": "x", "n": 950, "pct": 95.0}, {"label": "y", "n": 50, "pct": 5.0}], True, ["c"], ["a", "b", "c"], "Classification", 30)
    got = {(s, t): x for s, _, t, x in cards}
    assert got["critical", "possible target leakage"] == "leak" and got["critical", "more than half of the values are missing"] == "gap"
    assert got["critical", "severe class imbalance"] == "t" and got["warning", "duplicate rows"] == "7" and got["warning", "missing values"] == "some"
    assert got["warning", "highly correlated features"] == "a and b" and got["info", "strong feature correlations"] == "c and d"
    assert got["warning", "outliers"] == "a" and got["warning", "constant columns"] == "flat" and got["info", "heavy-tailed features"] == "a"
    assert got["info", "feature cluster"] == "a, b, c" and got["info", "weak signal for the target"] == "t" and got["info", "date columns"] == "day"
    order = [advice.RANK[s] for s, *_ in cards]
    assert order == sorted(order)
    top = advice.insights(profile, ["leak"], 7, "t", stats, [], [], [], False, [], [], "Classification", 2)
    assert len(top) == 2 and top[0][1] >= top[1][1]


def test_columns_by_role_and_treatment():
    assert advice.by_role({"a": "numeric", "b": "text", "c": "numeric"}) == {"numeric": ["a", "c"], "text": ["b"]}
    plan = [{"col": "a", "treatment": "exclude", "reason": "leak"}, {"col": "b", "treatment": "numeric", "reason": None}, {"col": "c", "treatment": "exclude", "reason": "leak"}]
    assert advice.by_treatment(plan) == {"exclude (leak)": ["a", "c"], "numeric": ["b"]}


@pytest.mark.parametrize(("change", "verdict"), [("none", "ready"), ("shift", "fix"), ("copied", "blocked"), ("text", "blocked"), ("gone", "blocked")])
def test_two_tables(spark, change, verdict):
    train = spark.range(2000).select((F.col("id") * 7919 % 1000).cast("double").alias("x"), F.concat(F.lit("k"), F.col("id") % 4).alias("k"), F.when(F.col("id") % 2 == 0, "y").otherwise("n").alias("t"), F.col("id").alias("n"))
    test = spark.range(2000, 3000).select(((F.col("id") * 7919 + 3) % 1000 + 0.5).alias("x"), F.concat(F.lit("k"), F.col("id") % 4).alias("k"), F.when(F.col("id") % 2 == 0, "y").otherwise("n").alias("t"), F.col("id").alias("n"))
    if change == "shift":
        test = test.withColumn("x", F.col("x") + 800)
    if change == "copied":
        test = test.unionByName(train.limit(3))
    if change == "text":
        test = test.withColumn("x", F.lit("about five"))
    if change == "gone":
        test = test.drop("k")
    out = compare.compare(train, test, {"x": "numeric", "k": "categorical", "t": "binary", "n": "identifier"}, "t", ["x", "k"])
    found = out["findings"].collect()
    assert {r["verdict"] for r in found} == {verdict}, [r["finding"] for r in found]
    if change == "shift":
        assert out["shift"].first()["col"] == "x" and out["shift"].first()["level"] == "major"
    if change == "copied":
        assert out["overlap"].first()["copied"] == 3


def test_proxies_and_pairs(spark):
    v = spark.createDataFrame([("sex", "job", 100, 0.5), ("town", "job", 90, 0.2), ("zip", "sex", 80, 0.9)], "a string, b string, n bigint, v double")
    r = spark.createDataFrame([("age", "pay", 70, -0.6), ("pay", "tax", 70, 0.9)], "a string, b string, n bigint, r double")
    got = [(x["col"], x["other"], x["metric"], x["value"]) for x in relations.proxies(["sex", "age"], v, r).collect()]
    assert got == [("age", "pay", "r", 0.6), ("sex", "zip", "V", 0.9), ("sex", "job", "V", 0.5)]
    assert relations.unmeasured_pairs("x", {"x": "numeric", "y": "categorical", "z": "binary", "w": "numeric", "t": "text"}) == 1
    m = spark.createDataFrame([("a", "b", 9, 0.1), ("a", "c", 9, -0.8), ("b", "c", 9, 0.2)], "a string, b string, n bigint, r double")
    rho = spark.createDataFrame([("a", "b", 9, 0.7), ("a", "c", 9, -0.8), ("b", "c", 9, 0.2)], "a string, b string, n bigint, rho double")
    assert [(x["a"], x["b"], x["direction"], x["monotonic_not_linear"]) for x in relations.strong_pairs(m, rho).collect()] == [("a", "c", "negative", False), ("a", "b", "positive", True)]
    kinds = [k for k, _ in relations.observations([{"col": "a", "abs_value": 0.05, "n": 30, "mi": 0.4}], 100, "t")]
    assert kinds == ["no_signal", "narrow", "not_monotonic"]


def test_samples(spark):
    df = spark.range(300).select("id", F.when(F.col("id") < 280, "big").otherwise("small").alias("s"), (F.col("id") % 5).alias("g"))
    got = sampling.stratified_sample(df, "s", 40).collect()
    assert len(got) == 40 and sum(r["s"] == "small" for r in got) == 20
    capped = sampling.stratified_sample(df, "s", 100, "g", 3).collect()
    assert max(sum(r["g"] == g for r in capped) for g in range(5)) <= 3
    assert [r["id"] for r in sampling.snapshot(df, F.col("id"), 3).collect()] == [0, 1, 2]
    parts = [spark.createDataFrame([(1, "a"), (2, "b")], "rank int, x string"), spark.createDataFrame([(1, "c")], "rank int, x string")]
    assert [r["x"] for r in sampling.interleaved(parts, "rank").collect()] == ["a", "c", "b"]
    one = sample.sample(spark)
    assert one.count() == 503 and one.count() - one.distinct().count() >= 3


def test_dossiers_and_payloads():
    assert claims.parse_answer('```json\n{"a": [1]}\n```') == {"a": [1]} and claims.parse_answer("no") is None
    assert claims.relevant({"a": 0.9}, "a", {}) and not claims.relevant({"a": 0.0}, "a", {"a": 0.0})


def test_reports(spark):
    df = sample.sample(spark)
    result = {"profile": P.column_profile(P.value_counts(df.select("age", "churn")))}
    text = analysis.report(result, "A | <b>", "json")
    assert len(json.loads(text)["tables"]["profile"]) == 2
    assert exports.stem("Año 2024: sales/new.csv") and "/" not in exports.stem("a/b:c")


def test_rules_on_values(spark):
    df = spark.createDataFrame([("$5",), ("5 kg",), ("7",), ("-999",), ("x" * 90,), (None,)] * 3, "v string")
    counts = P.value_counts(df)
    rules = [{"col": "v", "kind": "unit_map", "factors": {"kg": 1000, "$": 1}}, {"col": "v", "kind": "treat_as_missing", "values": [-999]}, {"col": "v", "kind": "merge_levels", "to": {"x" * 90: "long"}}]
    got = {r["rule"]: r for r in cleaning.measured_rules(counts, rules).collect()}
    assert [got[i]["changed"] for i in range(3)] == [6, 3, 3] and got[1]["missing_after"] - got[1]["missing_before"] == 3
    assert [tuple(x) for x in got[0]["examples"]] == [("$5", "5"), ("5 kg", "5000")] and got[1]["examples"][0]["after"] is None
    assert len(got[2]["examples"][0]["before"]) == 61 and got[2]["examples"][0]["after"] == "long"
    assert [tuple(r) for r in cleaning.rule_examples(df, rules[1]).collect()] == [("-999", "(missing)")]
    assert "clean(df, rules)" in cleaning.rules_script(rules)


def test_month_start(spark):
    got = spark.range(1).select(accounts.month_start(F.to_timestamp(F.lit("2024-02-29 23:59:59"))).alias("m")).first()["m"]
    assert str(got)[:10] == "2024-02-01"
