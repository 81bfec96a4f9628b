"""What a date column says about splitting a table: drift of the target over equal-count periods, late columns, a cutoff."""

from __future__ import annotations

import datetime
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import as_number, family, is_missing, to_cell, typed_key
from ..functions.order import ordinals
from . import assoc
from .drift import PERIODS
from .temporal import day_first, parse_date

# Bounds of drift, and the least rows with a date.
DRIFT_P, DRIFT_RATE, DRIFT_SD = 0.001, 0.10, 0.2
LATE_EARLY, LATE_LATE = 90.0, 50.0
MIN_ROWS = 50


def date_values(df: DataFrame, column: str, first: bool = False):
    """A column's dates as timestamps: native ones as they are, text parsed."""
    return F.col(f"`{column}`").cast("timestamp") if family(df, column) == "timestamp" else F.when(~is_missing(to_cell(df, column)), parse_date(to_cell(df, column), first))


def pick_date(df: DataFrame, columns: list[str], counts: DataFrame | None = None) -> tuple[str, bool, bool] | None:
    """(column, day first, whether that is assumed) of the date column with most parseable values; null under 50. counts: value_counts() of text columns."""
    if not columns:
        return None
    text = [c for c in columns if family(df, c) != "timestamp"]
    order = {r["col"]: (r["day_first"], r["assumed"]) for r in day_first(counts.where(F.col("col").isin(*text))).collect()} if text and counts is not None else {}
    parsed = df.agg(*[F.count(date_values(df, c, order.get(c, (False, False))[0])).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    best = max(range(len(columns)), key=lambda i: (parsed[i], -i))
    return (columns[best], *order.get(columns[best], (False, False))) if parsed[best] >= MIN_ROWS else None


def placed(df: DataFrame, column: str, first: bool, tie: str | None = None) -> DataFrame:
    """df with datassay_ts, rn, rows and period (0 to 4): equal counts by time; rows without a date are left out."""
    ts = df.withColumn("datassay_ts", date_values(df, column, first))
    same = F.col(f"`{tie}`") if tie else F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return by_time(ts, same)


def by_time(ts: DataFrame, same: Column) -> DataFrame:
    """Rows with datassay_ts in the order of time, then same."""
    return ordinals(ts, F.unix_micros("datassay_ts").cast("double"), same).withColumn("period", (F.ceil(PERIODS * F.col("rn") / F.col("rows")) - 1).cast("int"))


def target_drift(rows: DataFrame, target: str, role: str) -> tuple[DataFrame, DataFrame]:
    """(periods, test): (period, n, start, end, value) and one row (kind, label, p, spread, drifts). rows: placed().

    A class target is told by its rarest class's rate and Cramer's V of period and class; a number by its mean and rank eta.
    """
    spark = rows.sparkSession
    times = [F.count("*").alias("n"), F.min("datassay_ts").alias("start"), F.max("datassay_ts").alias("end")]
    if role == "numeric":
        own = rows.select("period", "datassay_ts", as_number(rows, target).alias("v"))
        by = own.groupBy("period").agg(*times, F.avg("v").alias("value"), F.count("v").alias("m"), F.coalesce(F.var_pop("v"), F.lit(0.0)).alias("s")).orderBy("period").collect()
        with_ = [r for r in by if r["m"]]
        total = sum(r["m"] for r in with_)
        mean = sum(r["m"] * r["value"] for r in with_) / total if total else 0.0
        sd = math.sqrt(sum(r["m"] * (r["s"] + (r["value"] - mean) ** 2) for r in with_) / (total - 1)) if total > 1 else 0.0
        found = [r["value"] for r in with_]
        spread = (max(found) - min(found)) / sd if found and sd > 0 else 0.0
        p = assoc.rank_eta(own.select("v", F.col("period").cast("string").alias("g")), "v", "g").first()["p"]
        label, kind, bar = target, "mean", DRIFT_SD
        periods = [(r["period"], r["n"], r["start"], r["end"], r["value"]) for r in by]
    else:
        cells = rows.groupBy("period", typed_key(rows, target).cast("string").alias("k")).agg(*times).collect()  # a row a period and class
        classes: dict[str, int] = {}
        for r in cells:
            if r["k"] is not None:
                classes[r["k"]] = classes.get(r["k"], 0) + r["n"]
        label = min(classes, key=lambda k: (classes[k], k), default=None)
        periods, found = [], []
        for g in sorted({r["period"] for r in cells}):
            own = [r for r in cells if r["period"] == g]
            known = sum(r["n"] for r in own if r["k"] is not None)
            value = sum(r["n"] for r in own if r["k"] == label) / known if known else None
            found += [value] if known else []
            periods.append((g, sum(r["n"] for r in own), min(r["start"] for r in own), max(r["end"] for r in own), value))
        spread = max(found) - min(found) if found else 0.0
        table = spark.createDataFrame([(str(r["period"]), r["k"], r["n"]) for r in cells if r["k"] is not None], "x string, y string, o bigint")
        p = assoc.cramers_columns(assoc.margin_sums(assoc.with_margins(table)), []).first()["p"]
        kind, bar = "rate", DRIFT_RATE
    drifts = p is not None and p < DRIFT_P and spread >= bar
    return spark.createDataFrame(periods, "period int, n bigint, start timestamp, end timestamp, value double"), spark.createDataFrame([(kind, label, p, float(spread), drifts)], "kind string, label string, p double, spread double, drifts boolean")


def late_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(col, starts_at, early_pct, late_pct): columns at least 90 % missing in the first fifth by time and at most 50 % in the last; rows: placed()."""
    edge = F.greatest(F.lit(1), F.floor(F.col("rows") / PERIODS))
    each = F.array(*[F.struct(F.lit(c).alias("col"), is_missing(to_cell(rows, c)).alias("gone")) for c in columns])
    flat = rows.select("datassay_ts", (F.col("rn") <= edge).alias("first"), (F.col("rn") > F.col("rows") - edge).alias("last"), F.explode(each).alias("e")).select("datassay_ts", "first", "last", "e.*")
    pct = lambda side: F.floor(F.avg(F.when(F.col(side), F.col("gone").cast("double"))) * 1000 + 0.5) / 10
    by = flat.groupBy("col").agg(pct("first").alias("early_pct"), pct("last").alias("late_pct"), F.min(F.when(~F.col("gone"), F.col("datassay_ts"))).alias("starts_at"))
    return by.where((F.col("early_pct") >= LATE_EARLY) & (F.col("late_pct") <= LATE_LATE)).select("col", "starts_at", "early_pct", "late_pct")


def future_rows(df: DataFrame, column: str, now: datetime.datetime, first: bool = False) -> DataFrame:
    """(future): rows dated more than a day after `now`."""
    return df.agg(F.count_if(date_values(df, column, first) > F.lit(now + datetime.timedelta(days=1)).cast("timestamp")).alias("future"))


def cutoff(rows: DataFrame, share: float = 0.8) -> DataFrame:
    """The time at place floor(share * (n - 1)); rows: placed()."""
    return rows.where(F.col("rn") == F.floor(share * (F.col("rows") - 1)) + 1).select(F.col("datassay_ts").alias("cutoff"))


def time_split(df: DataFrame, column: str, at, first: bool = False) -> tuple[DataFrame, DataFrame]:
    """(train, test): rows before the cutoff, and those from it on; rows without a date are on neither side."""
    ts, limit = date_values(df, column, first), F.lit(at).cast("timestamp")
    return df.where(ts < limit), df.where(ts >= limit)


def time_checks(df: DataFrame, dates: list[str], roles: dict[str, str], target: str | None, counts: DataFrame | None = None, now: datetime.datetime | None = None, tie: str | None = None) -> dict | None:
    """column, day_first, assumed, periods, target (one row), late, future, cutoff, recommend_time_split; null without a date column."""
    found = pick_date(df, dates, counts)
    if not found:
        return None
    column, first, assumed = found
    watched = [c for c in roles if c not in (column, target)]
    told = bool(target) and roles.get(target) in ("numeric", "binary", "categorical")
    same = F.col(f"`{tie}`").cast("double") if tie else F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(1 << 52)).cast("double")
    # Dates are parsed once; what is asked of the other columns is a row of flags.
    gone = F.array(*[is_missing(to_cell(df, c)) for c in watched]) if watched else F.array().cast("array<boolean>")
    slim = df.select(date_values(df, column, first).alias("datassay_ts"), same.alias("datassay_tie"), gone.alias("datassay_gone"), *([F.col(f"`{target}`")] if told else [])).where("datassay_ts is not null").persist()
    rows = by_time(slim, F.col("datassay_tie")).persist()
    out = {"column": column, "day_first": first, "assumed": assumed, "others": [c for c in dates if c != column]}
    drifts = False
    if told:
        out["periods"], out["target"] = target_drift(rows, target, roles[target])
        drifts = out["target"].first()["drifts"]
    # Late columns, the cutoff and rows from the future in one aggregation.
    edge = F.greatest(F.lit(1), F.floor(F.col("rows") / PERIODS))
    early, late, ts = F.col("rn") <= edge, F.col("rn") > F.col("rows") - edge, F.col("datassay_ts")
    pct = lambda side, i: F.floor(F.avg(F.when(side, F.col("datassay_gone")[i].cast("double"))) * 1000 + 0.5) / 10
    asked = [F.struct(F.lit(c).alias("col"), F.min(F.when(~F.col("datassay_gone")[i], ts)).alias("starts_at"), pct(early, i).alias("early_pct"), pct(late, i).alias("late_pct")).alias(f"c{i}") for i, c in enumerate(watched)]
    limit = F.lit((now or datetime.datetime.now()) + datetime.timedelta(days=1)).cast("timestamp")
    one = rows.agg(F.min(F.when(F.col("rn") == F.floor(0.8 * (F.col("rows") - 1)) + 1, ts)).alias("cutoff"), F.count_if(ts > limit).alias("future"), *asked).first()
    slim.unpersist()
    rows.unpersist()
    found_late = [tuple(one[f"c{i}"]) for i in range(len(watched)) if (one[f"c{i}"]["early_pct"] or 0.0) >= LATE_EARLY and one[f"c{i}"]["late_pct"] is not None and one[f"c{i}"]["late_pct"] <= LATE_LATE]
    out["late"] = df.sparkSession.createDataFrame(found_late, "col string, starts_at timestamp, early_pct double, late_pct double")
    out["future"], out["cutoff"] = one["future"], one["cutoff"]
    out["recommend_time_split"] = bool(drifts or found_late)
    return out

