"""Known answers: statistics, tails, ridge, cleaning, dates, intake, reports, streaming."""

import math

import pytest
from pyspark.sql import functions as F

from datassay.functions import cells, special
from datassay.operators import assoc, cleaning, drift, groups, prep, profile, stats, temporal
from datassay.sources import delimited, reports
from datassay.streaming import incremental


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_number_and_missing_policies(spark):
    rows = [(" 1 ",), ("1e5",), (".5",), ("5.",), ("+3",), ("-0",), ("1,234",), ("12kg",), ("Infinity",), ("1E400",), ("1d",), ("NaN",), (None,), (" N/A ",), ("\t\n",), ("?",)]
    df = spark.createDataFrame(rows, "c string")
    got = [(r["x"], r["m"]) for r in df.select(cells.number(F.col("c")).alias("x"), cells.is_missing(F.col("c")).alias("m")).collect()]
    assert [x for x, _ in got] == [1.0, 1e5, 0.5, 5.0, 3.0, 0.0] + [None] * 10
    assert [m for _, m in got] == [False] * 11 + [True] * 5
    keys = [r[0] for r in spark.createDataFrame([("1",), ("1.0",), (" 1 ",), ("-0",), ("Ab ",)], "c string").select(cells.key(F.col("c"))).collect()]
    assert keys == ["1", "1", "1", "0", "ab"]


def test_tails(spark):
    row = one(spark, special.chi2_tail(F.lit(3.841458820694124), F.lit(1.0)).alias("a"), special.chi2_tail(F.lit(18.307038053275146), F.lit(10.0)).alias("b"), special.correlation_p(F.lit(0.4658786571), F.lit(150)).alias("c"), special.correlation_p(F.lit(-0.1226036706), F.lit(150)).alias("d"), special.chi2_tail(F.lit(1.0), F.lit(0.0)).alias("e"))
    assert row["a"] == pytest.approx(0.05, abs=1e-9) and row["b"] == pytest.approx(0.05, abs=1e-9)
    assert row["c"] == pytest.approx(1.8816e-9, rel=1e-3) and row["d"] == pytest.approx(0.1350017573, abs=1e-8) and row["e"] is None


def test_moments_of_a_small_column(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 4.0, 10.0)] + [(None,)], "x double")
    r = stats.moments(stats.numbers(profile.value_counts(df))).first()
    assert r["mean"] == 4 and r["std"] == pytest.approx(math.sqrt(12.5)) and r["skew"] == pytest.approx(1.6971, abs=1e-4) and r["kurtosis"] == pytest.approx(3.152, abs=1e-3)


def test_quantiles_do_not_depend_on_row_order(spark):
    df = spark.range(1001).select((F.col("id") % 97).cast("double").alias("x"))
    q = lambda d: tuple(stats.quantiles(stats.numbers(profile.value_counts(d)), {"a": 0.1, "b": 0.5, "c": 0.99}).first())
    values = sorted(i % 97 for i in range(1001))
    assert q(df) == q(df.orderBy(F.desc("x")).repartition(3)) == ("x", values[100], values[500], values[990])


def test_empty_tables_give_empty_or_zero_results(spark):
    df = spark.createDataFrame([], "a double, b string")
    counts = profile.value_counts(df)
    assert profile.column_profile(counts).count() == 0 and stats.statistics(counts).count() == 0
    assert profile.duplicate_rows(df).first()["rows"] == 0
    assert groups.label_conflicts(df, ["a"], "b").first()["groups"] == 0


def test_label_conflicts_and_id_only_repeats(spark):
    rows = [(1, 30, "X", "yes"), (2, 30, "X", "no"), (3, 31, "X", "yes"), (4, 31, "X", "yes"), (5, 40, "Y", None), (6, 41, "Y", "no"), (7, 42, "Z", "no")]
    df = spark.createDataFrame(rows, "id int, age int, city string, y string")
    r = groups.label_conflicts(df, ["age", "city"], "y").first()
    assert (r["conflict_groups"], r["conflict_rows"], r["groups"]) == (1, 2, 4)
    assert groups.id_only_repeats(df, ["age", "city"], ["id"], "y").first()["repeats"] == 1
    e = groups.conflict_examples(df, ["age", "city"], "y", F.col("id") - 1).first()
    assert e["lines"] == [2, 3] and e["targets"] == ["no", "yes"]


def test_psi_of_a_table_with_itself_is_zero_and_shift_shows(spark):
    a = spark.range(2000).select((F.col("id") % 100).cast("double").alias("x"))
    assert drift.psi(drift.numeric_bins(a, a, "x")).first()["psi"] == 0
    assert drift.psi(drift.numeric_bins(a, a.select((F.col("x") + 40).alias("x")), "x")).first()["psi"] > 0.25
    assert drift.ks_two_sample(a, a, "x").first()["d"] == pytest.approx(0, abs=1e-12)


def test_ridge_known_coefficients(spark):
    import numpy as np

    r = np.random.default_rng(1)
    x = r.normal(size=(50, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + r.normal(size=50) * 0.1
    df = spark.createDataFrame([(*map(float, row), float(v)) for row, v in zip(x, y)], "a double, b double, c double, y double")
    got = {t["term"]: t["value"] for t in prep.ridge(df, ["a", "b", "c"], "y", alpha=1.0).collect()}
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc)
    assert [got["a"], got["b"], got["c"]] == pytest.approx(list(w), abs=1e-9)
    assert got["(intercept)"] == pytest.approx(y.mean() - x.mean(0) @ w, abs=1e-9)
    cv = prep.cross_validate(df, ["a", "b", "c"], "y").first()
    assert cv["score"] > 0.95 and cv["signal"]


def test_spearman_is_one_for_monotone_columns(spark):
    wide = assoc.frame(spark.range(1, 60).select(F.col("id").cast("double").alias("a"), F.exp(F.col("id") / 5).alias("b")), ["a", "b"])
    assert assoc.spearman(wide, "a", "b").first()["rho"] == pytest.approx(1)
    assert assoc.pearson_pairs(wide, ["a", "b"]).first()["r"] < 0.8


def test_dates(spark):
    texts = ["2024-02-30", "2024-02-29", "2024-03-01T10:30:00+02:00", "31/12/49", "12/31/1999", "5 Mar 2020", "2024/1/5", "hello", "13/13/2020"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(temporal.family(F.col("t")).alias("f"), temporal.parse_date(F.col("t")).cast("string").alias("mdy"), temporal.parse_date(F.col("t"), True).cast("string").alias("dmy")).collect()
    assert [r["f"] for r in rows] == ["iso", "iso", "iso", "slash_dm", "slash_dm", "month", "slash_ymd", None, None]
    assert rows[0]["mdy"] is None and rows[1]["mdy"] == "2024-02-29 00:00:00" and rows[2]["mdy"] == "2024-03-01 08:30:00"
    assert rows[3]["dmy"] == "2049-12-31 00:00:00" and rows[4]["mdy"] == "1999-12-31 00:00:00" and rows[5]["mdy"] == "2020-03-05 00:00:00"


def test_cleaning_rules(spark):
    df = spark.createDataFrame([("10 Lac",), ("501000",), ("125+",), ("<5",), ("-999",), (None,)], "p string")
    rules = [{"col": "p", "kind": "unit_map", "factors": {"lac": 100000}}, {"col": "p", "kind": "censored_numeric"}, {"col": "p", "kind": "treat_as_missing", "values": [-999]}]
    assert [r[0] for r in cleaning.clean(df, rules).collect()] == ["1000000", "501000", "125", "5", None, None]


def test_personal_kinds(spark):
    want = {"a.b@c.example.com": "email", "https://x.org/1": "url", "10.1.2.3": "ip", "DE89370400440532013000": "iban", "4539578763621486": "card", "+1 202 555 0175": "phone", "2020-01-02": None, "12345": None}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r["t"]: r["k"] for r in df.select("t", cleaning.personal_kind(F.col("t")).alias("k")).collect()} == want


def test_delimited_intake(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes(b"\xef\xbb\xbfid;;name\n1;2;\"x;y\"\n2;3\n\n3;4;z\n")
    df, seen = delimited.read_delimited(spark, str(p))
    assert seen.delimiter == ";" and seen.columns == ["id", "column_2", "name"] and not seen.headerless
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", "2", "x;y"), ("2", "3", None), ("3", "4", "z")]
    q = tmp_path / "b.csv"
    q.write_text("-1.5,0.25\n2.5,3.5\n")
    df, seen = delimited.read_delimited(spark, str(q))
    assert seen.headerless and df.count() == 2 and df.columns == ["column_1", "column_2"]


def test_report_store_keeps_the_newest(spark, tmp_path):
    path = str(tmp_path / "store")
    for i in range(4):
        reports.save(spark, path, f"r{i}", f"n{i}", f"2024-01-0{i + 1}", "{}", keep=3)
    reports.save(spark, path, "r2", "again", "2024-02-01", "{}", keep=3)
    assert [(r["id"], r["name"]) for r in reports.list_reports(spark, path).collect()] == [("r2", "again"), ("r3", "n3"), ("r1", "n1")]
    assert reports.get_report(spark, path, "r3").first()["result"] == "{}"


def test_streamed_profile_equals_the_batch(spark, tmp_path):
    df = spark.range(100).select(F.col("id").cast("string").alias("a"), F.when(F.col("id") % 4 == 0, "NA").otherwise("x").alias("b"))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.profile_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r["col"]: r for r in incremental.merged(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got["a"]["rows"] == 100 and got["a"]["mean"] == pytest.approx(49.5) and got["b"]["missing"] == 25


def test_recommendations_on_outliers_skew_levels_balance_and_no_signal():
    from datassay.operators import score

    column = lambda c, role, distinct: {"col": c, "role": role, "rows": 1000, "missing": 0, "present": 1000, "distinct_raw": distinct}
    numbers = lambda c, least, most, skew, outliers: {"col": c, "n": 1000, "min": least, "max": most, "skew": skew, "outliers": outliers}
    profile = [column("t", "binary", 2), *[column(c, "numeric", 500) for c in "abcd"], column("free", "categorical", 999), column("tail", "categorical", 960)]
    stats_ = [numbers("a", 0, 7, 3.0, 30), numbers("b", -5.0, 90.0, -2.5, 0), numbers("c", 0.5, 900.0, 4.0, 120), numbers("d", 0, 9, 1.9, 20)]
    weak = [{"col": "a", "abs_value": 0.02, "p": 0.6}, {"col": "b", "abs_value": None, "p": None}]
    got = {(p, c, a.split(":")[0]) for _, p, _, c, a in score.recommendations(profile, [], 0, 1000, "t", [], stats_, {"free": 0.002, "tail": 0.03}, weak, 95.0)}
    assert got == {
        ("low", "a", "review 30 outliers (3%)"), ("medium", "c", "investigate 120 outliers (12%)"), ("low", "a", "leave as is or bin"), ("low", "b", "apply a Yeo-Johnson transform"), ("low", "c", "apply log1p"), ("low", "a", "consider dropping"),
        ("medium", "free", "do not encode or group"), ("medium", "tail", "group rare levels, then encode by target or frequency"), ("high", "t", "engineer features or bring in more data"), ("high", "t", "weight classes and oversample"),
    }
