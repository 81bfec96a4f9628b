"""Cases that once gave wrong answers or stopped: text cells in formulas, dotted levels, cut tables, unbalanced folds."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from datassay.functions.cells import typed_key
from datassay.operators import claims, cleaning, groups, model, prep, relations
from datassay.sources import delimited, exports


def test_formulas_and_leaks_on_files_as_read(spark, tmp_path):
    (tmp_path / "f.csv").write_text("net,tax,gross,shop,late\n" + "".join(f"{i},{i / 10},{i * 1.1:.4f},s{i % 4},{i % 4}\n" for i in range(1, 61)) + ",3,5,s1,\nn/a,x,7,,1\n")
    df, _ = delimited.read_delimited(spark, str(tmp_path / "f.csv"))
    one = groups.formula_check(df, "gross", "sum", ["net", "tax"]).first()
    assert (one["rows"], one["matches"]) == (60, 60)
    assert groups.formula_offsets(df, "gross", ["net", "tax"]).first()["offset"] == 0.0
    roles = dict.fromkeys(df.columns, "numeric") | {"shop": "categorical"}
    found = [{"column": "net", "category": "derived_from_target", "op": "sum", "terms": ["net", "tax"]}, {"column": "shop", "category": "group_leak"}, {"column": "late", "category": "restates_label"}, {"column": "gone", "category": "group_leak"}, {"column": "gross", "category": "group_leak"}]
    out = claims.verify_leaks(df, found, roles, "gross", {"late": 0.97}, ["tax", "net"], ["late"])
    got = {(r["column"], r["category"]): (r["verdict"], r["flagged"]) for r in out["findings"].collect()}
    assert got["net", "derived_from_target"] == ("confirmed", True) and got["late", "restates_label"] == ("confirmed", False)
    assert got["shop", "group_leak"][0] in ("contradicted", "partial")
    assert {r["column"] for r in out["withheld"].collect()} == {"gone", "gross"}
    assert [r["column"] for r in out["engine_only"].collect()] == ["tax"] and out["not_raised"].count() == 0


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_the_exported_script_runs(spark, tmp_path, task):
    r = random.Random(2)
    rows = [(r.choice(["a.b", "c d", "e=f", "`g`"]), r.random() if r.random() > 0.1 else "", i) for i, _ in enumerate(range(120))]
    (tmp_path / "your_file.csv").write_text("lvl.x,num,target\n" + "".join(f"{a},{b},{(i % 2) if task == 'classification' else i}\n" for a, b, i in rows))
    plan = model.Plan("target", task, {"num": ("median", True)}, {"lvl.x": False})
    script = exports.preparation_script(plan).replace("your_file.csv", str(tmp_path / "your_file.csv"))
    scope: dict = {}
    exec(compile(script, "script", "exec"), scope)  # noqa: S102
    assert scope["x"].columns[0] == "datassay_y" and all("." not in c for c in scope["x"].columns) and scope["x"].count() > 60
    book = json.loads(exports.to_notebook(script))
    assert sum(c["cell_type"] == "code" for c in book["cells"]) == 7


def test_json_holds_whole_tables(spark):
    got = json.loads(exports.to_json({"t": spark.range(1500), "snapshot": spark.range(3)}, "n"))
    assert len(got["tables"]["t"]) == 1500 and "snapshot" not in got["tables"]


def test_dealing_by_sizes_is_the_greedy_one():
    r = random.Random(5)
    for _ in range(200):
        sizes = [r.randint(1, 6) for _ in range(r.randint(0, 60))] + [r.randint(20, 90)] * r.randint(0, 2)
        load, want = [0] * 4, [0] * 4
        for n, m in sorted(Counter(sizes).items(), reverse=True):
            for f, x in enumerate(prep.dealt(load, n, m)):
                load[f] += x * n
        for n in sorted(sizes, reverse=True):
            want[want.index(min(want))] += n
        assert load == want


def test_grouped_folds_are_even_and_whole(spark):
    rows = [(f"g{i}", i * 100 + j) for i in range(2000) for j in range(1 + i % 3)] + [("big", -j) for j in range(900)] + [(None, 10**6 + j) for j in range(40)]
    got = prep.grouped_folds(spark.createDataFrame(rows, "g string, i int").repartition(6), "g").collect()
    assert len(got) == len(rows)
    where = {}
    for r in got:
        if r["g"] is not None:
            assert where.setdefault(r["g"], r["fold"]) == r["fold"]
    load = Counter(r["fold"] for r in got)
    assert max(load.values()) - min(load.values()) <= 3
    again = prep.grouped_folds(spark.createDataFrame(rows, "g string, i int").repartition(3), "g").collect()
    assert {r["i"]: r["fold"] for r in got} == {r["i"]: r["fold"] for r in again}


def test_contingencies_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(relations, "HELD_CELLS", 10)
    r = random.Random(3)
    rows = [tuple(r.choice(["x", "y.z", "ü", None]) if k < 2 else r.choice([1, 2, None]) for k in range(3)) for _ in range(400)]
    df = spark.createDataFrame(rows, "a string, `b.c` string, d int").repartition(5)
    pairs = [("a", "b.c"), ("a", "d"), ("b.c", "d")]
    keyed = df.select(*[typed_key(df, c).alias(c) for c in df.columns])
    got = {(x["a"], x["b"], x["x"], x["y"]): x["o"] for x in relations.contingencies(keyed, pairs).collect()}
    at = {"a": 0, "b.c": 1, "d": 2}
    assert got == Counter((a, b, str(row[at[a]]), str(row[at[b]])) for row in rows for a, b in pairs if row[at[a]] is not None and row[at[b]] is not None)
    assert relations.contingencies(keyed.limit(0), pairs).count() == 0


def test_collision_keys(spark):
    want = {"R-JR": "rjr", "R JR": "rjr", "Las Vegas": "lasvegas", "85 Lac": "85lac", "8.5 Lac": "8.5lac", "-1,4": "-1,4", "1,4": "1,4", "20,0": "20,0", "-200": "-200", "<=50K": "<=50k", ">50K": ">50k", "adria¡n": "adrian", "a-5": "a5", "(-5)": "-5", "1.": "1", ".5": "5", "é.1": "é1"}
    df = spark.createDataFrame([(k,) for k in want], "v string")
    assert {r["v"]: r["k"] for r in df.select("v", cleaning.collision_key(F.col("v")).alias("k")).collect()} == want
