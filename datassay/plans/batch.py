"""Many files at once: each one's intake verdict and analysis, and checks of the engine against what is known of files."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from ..operators import profile as prof
from ..operators import score
from ..operators.temporal import temporal_columns
from ..sources.delimited import read_many
from . import analysis

REPORT = "file string, encoding string, delimiter string, headerless boolean, rows bigint, columns int, ragged bigint, target string, health int, grade string, seconds double, error string"
CHECKS = "file string, kind string, ok boolean, note string"


def guessed(df: DataFrame) -> str | None:
    """The column that looks like the target."""
    counts = prof.value_counts(df).persist()
    out = score.guess_target(prof.roles(prof.column_profile(counts), temporal_columns(counts)), counts)
    counts.unpersist()
    return out


def report_many(spark: SparkSession, path: str, target: str | None = None) -> DataFrame:
    """REPORT: a row a file under a path or glob. All are taken in by one scan; what can't be used or fails has an error and no health.

    target: analysed where a file has it; otherwise the target is guessed.
    """
    scan, verdicts = read_many(spark, path)
    rows = []
    for v in sorted(verdicts.collect(), key=lambda r: r["file"]):  # a row a file
        began, health, goal, error = time.time(), None, None, None
        if v["unusable"]:
            error = "no columns or no rows"
        else:
            try:
                df = scan.table(v["file"]).persist()
                goal = target if target in df.columns else guessed(df)
                health = analysis.profile(df, goal)["health"].first()
                df.unpersist()
            except Exception as e:  # one file's failure is that file's result
                error = f"{type(e).__name__}: {str(e)[:200]}"
        rows.append((v["file"], v["encoding"], v["delimiter"], v["headerless"], v["rows"], len(v["columns"]), v["ragged"], goal, health and health["score"], health and health["grade"], time.time() - began, error))
    return spark.createDataFrame(rows, REPORT)


def engine_check(spark: SparkSession, expected: list[dict]) -> DataFrame:
    """CHECKS of files {file, target, signal}: crash (the analysis and the baseline finish), silent (every column is scored or has a reason),
    signal (the baseline's verdict is the expected one; null: not checked)."""
    out = []
    for e in expected:
        try:
            scan, _ = read_many(spark, e["file"])
            df = scan.table(next(iter(scan.files))).persist()
            result = analysis.profile(df, e["target"])
            found = analysis.diagnosed(df, result, e["target"])
            df.unpersist()
        except Exception as x:  # what the check is for
            out.append((e["file"], "crash", False, f"{type(x).__name__}: {str(x)[:200]}"))
            continue
        failed = found["status"] != "ok" and "failed" in found.get("reason", "")
        out.append((e["file"], "crash", not failed, found.get("reason") if failed else None))
        told = {r["col"] for k in ("associations", "unscored") if k in result for r in result[k].collect()}
        silent = [c for c in df.columns if c != e["target"] and c not in told]
        out.append((e["file"], "silent", not silent, ", ".join(silent) or f"{len(df.columns) - 1} columns told of"))
        if e.get("signal") is not None:
            got = found.get("signal") if found["status"] == "ok" else f"unavailable: {found['reason']}"
            out.append((e["file"], "signal", got == e["signal"], f"{got}, expected {e['signal']}"))
    return spark.createDataFrame(out, CHECKS)
