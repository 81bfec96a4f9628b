"""Many files, checks of the engine, and payloads in parts."""

import random

from datassay.operators import claims
from datassay.plans import batch


def write(path, n, signal):
    r = random.Random(n)
    rows = [(r.gauss(0, 1), r.choice(["u", "v", "w"])) for _ in range(n)]
    path.write_text("x,k,churn\n" + "".join(f"{x:.4f},{k},{'yes' if (x > 0 if signal else r.random() > 0.5) else 'no'}\n" for x, k in rows))


def test_many_files_and_the_engine(spark, tmp_path):
    write(tmp_path / "a.csv", 120, True)
    (tmp_path / "b.txt").write_bytes("stadt;wert\nköln;1\nbern;2\nkiel\n".encode("cp1252"))
    (tmp_path / "c.csv").write_text("only,names\n")
    got = {r["file"].rsplit("/", 1)[1]: r for r in batch.report_many(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["a.csv", "b.txt", "c.csv"]
    assert got["a.csv"]["target"] == "churn" and got["a.csv"]["error"] is None and 0 <= got["a.csv"]["health"] <= 100
    assert (got["b.txt"]["encoding"], got["b.txt"]["rows"], got["b.txt"]["ragged"]) == ("windows-1252", 3, 1)
    assert got["c.csv"]["error"] and got["c.csv"]["health"] is None
    checks = {(r["kind"]): r for r in batch.engine_check(spark, [{"file": str(tmp_path / "a.csv"), "target": "churn", "signal": True}]).collect()}
    assert all(r["ok"] for r in checks.values()) and set(checks) == {"crash", "silent", "signal"}, checks
    missing = batch.engine_check(spark, [{"file": str(tmp_path / "none.csv"), "target": "x", "signal": None}]).collect()
    assert [(r["kind"], r["ok"]) for r in missing] == [("crash", False)]


def test_payload_in_parts(spark):
    payload = spark.createDataFrame([(i, f"c{i}") for i in range(60)], "pos int, col string").repartition(4)
    got = {r["col"]: (r["part"], r["parts"]) for r in claims.payload_parts(payload).collect()}
    assert got["c0"] == (1, 3) and got["c24"] == (1, 3) and got["c25"] == (2, 3) and got["c59"] == (3, 3)
    one = {"columns": [1, 2], "target_candidates": ["a", "b", "c"], "rules": [], "row_grain": ""}
    two = {"columns": [3], "target_candidates": ["d"], "row_grain": "a day"}
    assert claims.merged_answers([one, None, two]) == {"row_grain": "a day", "columns": [1, 2, 3], "target_candidates": ["a", "d", "b", "c"], "rules": []}
    assert claims.merged_answers([]) == {"row_grain": "", "columns": [], "target_candidates": [], "rules": []}
