"""The preparation plan fitted on some rows and applied to any, and the cross-validated baseline on top of it.

A fit learns fills, scales, levels and bins in one aggregation over the training rows; a transform is a projection. The baseline is
operators.baseline's: rows are read a fixed number of times whatever the folds and columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import family, is_missing, level_key, native, number, row_key, to_cell, typed_key
from ..functions.order import select_places
from . import baseline
from .prep import SUSPICIOUS, T_LIMIT, UNSTABLE, plain_folds

# Fixed values of the baseline.
MAX_LEVELS, QUANTILE_BINS, FOLDS, MIN_ROWS = 20, 20, 5, 50
#: Classes of a target that can be told apart; beyond, it is no class target.
MAX_CLASSES = 1000
REST = "(infrequent)"


@dataclass
class Plan:
    """What becomes of each column: numeric (how to fill, flagged), categorical (flagged), presence."""

    target: str
    task: str  # "regression" or "classification"
    numeric: dict[str, tuple[str, bool]] = field(default_factory=dict)
    categorical: dict[str, bool] = field(default_factory=dict)
    presence: list[str] = field(default_factory=list)
    group_by: str | None = None
    stratify: bool = False
    drop_duplicates: bool = False

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical, *self.presence]


def impute_strategy(role: str, skew: float | None) -> str:
    """How missing values of a role are filled."""
    if role == "temporal":
        return "forward_fill"
    if role in ("categorical", "binary") or skew is None:
        return "most_frequent"
    return "median" if abs(skew) > 1 else "mean"


def _number(df: DataFrame, c: str) -> Column:
    if family(df, c) in ("double", "bigint"):
        x = F.col(f"`{c}`").cast("double")
        return F.when(~F.isnan(x), x)
    return number(to_cell(df, c))


def _level(df: DataFrame, c: str) -> Column:
    return level_key(df, c)


def usable_rows(df: DataFrame, plan: Plan, order: Column | None = None) -> DataFrame:
    """Rows with a target (a number, for regression); of exact duplicates one copy, if the plan drops them."""
    ok = _number(df, plan.target).isNotNull() if plan.task == "regression" else ~is_missing(to_cell(df, plan.target))
    out = df.where(ok)
    if plan.drop_duplicates:
        names = df.columns
        out = out.select("*", *row_key(out, names)).dropDuplicates(["k1", "k2"]).select(*names)
    return out


def encode_target(df: DataFrame, plan: Plan) -> tuple[DataFrame, list[str] | None]:
    """(df with y, classes): the number, or the class's index in sorted order."""
    if plan.task == "regression":
        return df.withColumn("datassay_y", _number(df, plan.target)), None
    level = _level(df, plan.target)
    classes = sorted(r["k"] for r in df.select(level.alias("k")).where("k is not null").distinct().limit(MAX_CLASSES + 1).collect())
    if len(classes) > MAX_CLASSES:
        raise ValueError(f"the target has more than {MAX_CLASSES} classes")
    return df.withColumn("datassay_y", (F.array_position(F.array(*[F.lit(c) for c in classes]), level) - 1).cast("double")), classes


def fit(train: DataFrame, plan: Plan, features: list[str] | None = None, bins: int = 0) -> list[dict]:
    """The fitted parts: numbers with fill, mean and scale (of the filled column) or quantile bins, levels with fill and a bucket for the rest, missing flags."""
    use = lambda c: features is None or c in features
    numeric = {c: v for c, v in plan.numeric.items() if use(c)}
    aggs = [F.count("*").alias("n")]
    for i, (c, (how, _)) in enumerate(numeric.items()):
        x = _number(train, c)
        fill = {"median": F.lit(None).cast("double"), "mean": F.avg(x), "most_frequent": F.mode(x, deterministic=True)}[how]
        aggs += [F.count(x).alias(f"n{i}"), F.sum(x).alias(f"s{i}"), F.coalesce(F.var_pop(x), F.lit(0.0)).alias(f"v{i}"), fill.alias(f"f{i}")]
    one = train.agg(*aggs).first()
    sorted_ = {str(i): (c, one[f"n{i}"]) for i, (c, (how, _)) in enumerate(numeric.items()) if one[f"n{i}"] and (bins or how == "median")}
    places = {i: {"m<": (m - 1) // 2, "m>": m // 2} | {f"e{j}": j * m // bins for j in range(1, bins)} for i, (_, m) in sorted_.items()}
    found: dict[str, dict[str, float]] = {}
    if places:
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("col"), _number(train, c).alias("num")) for i, (c, _) in sorted_.items()])).alias("e")
        values = train.select(each).select("e.*").where("num is not null").groupBy("col", "num").agg(F.count("*").alias("n")).persist()
        found = select_places(values, places)
        values.unpersist()
    parts: list[dict] = []
    n = one["n"]
    for i, (c, (_, flag)) in enumerate(numeric.items()):
        m = one[f"n{i}"]
        if not m:
            continue
        if bins:
            parts.append({"kind": "bins", "col": c, "edges": sorted({v for k, v in found[str(i)].items() if k[0] == "e"})})
            continue
        fill = (found[str(i)]["m<"] + found[str(i)]["m>"]) / 2 if numeric[c][0] == "median" else float(one[f"f{i}"])
        own = one[f"s{i}"] / m
        mean = (one[f"s{i}"] + (n - m) * fill) / n
        ss = m * (one[f"v{i}"] + (own - mean) ** 2) + (n - m) * (fill - mean) ** 2
        parts.append({"kind": "numeric", "col": c, "fill": fill, "mean": mean, "scale": math.sqrt(ss / n) or 1.0})
        if flag:
            parts.append({"kind": "missing", "col": c})
    categorical = [c for c in plan.categorical if use(c)]
    ranked: dict[str, list[str]] = {}
    if categorical:
        each = F.array(*[F.struct(F.lit(c).alias("col"), _level(train, c).alias("k")) for c in categorical])
        counts = train.select(F.explode(each).alias("e")).select("e.*").groupBy("col", "k").agg(F.count("*").alias("n"))
        gone = {r["col"]: r["n"] for r in counts.where("k is null").collect()}
        from pyspark.sql.window import Window

        # The fill takes the missing rows too, so it stays first; one level more than are kept tells whether there is a rest.
        top = counts.where("k is not null").withColumn("i", F.row_number().over(Window.partitionBy("col").orderBy(F.desc("n"), "k"))).where(F.col("i") <= MAX_LEVELS + 1)
        for r in sorted(top.collect(), key=lambda r: (r["col"], r["i"])):
            ranked.setdefault(r["col"], []).append(r["k"])
    for c in categorical:
        if c in ranked:
            levels = ranked[c] if len(ranked[c]) <= MAX_LEVELS else [*ranked[c][: MAX_LEVELS - 1], REST]
            parts.append({"kind": "levels", "col": c, "fill": ranked[c][0], "levels": levels})
            if plan.categorical[c]:
                parts.append({"kind": "missing", "col": c})
    parts += [{"kind": "missing", "col": c} for c in plan.presence if use(c)]
    return parts


def transform(df: DataFrame, parts: list[dict], keep: list[str] = ()) -> tuple[DataFrame, list[str]]:
    """(df of keep and one double column an output, their names): nothing is learned; an unseen level goes to the rest, or is all zero."""
    out: dict[str, Column] = {}
    for p in parts:
        c = p["col"]
        if p["kind"] == "numeric":
            out[c] = (F.coalesce(_number(df, c), F.lit(p["fill"])) - p["mean"]) / p["scale"]
        elif p["kind"] == "missing":
            out[f"{c}__missing"] = is_missing(to_cell(df, c)).cast("double")
        elif p["kind"] == "bins":
            x = _number(df, c)
            at = sum((F.when(x >= e, 1).otherwise(0) for e in p["edges"]), F.lit(0))
            out |= {f"{c}#{j}": F.coalesce((x.isNotNull() & (at == j)).cast("double"), F.lit(0.0)) for j in range(len(p["edges"]) + 1)}
            out[f"{c}#missing"] = x.isNull().cast("double")
        else:
            level = F.coalesce(_level(df, c), F.lit(p["fill"]))
            named = [k for k in p["levels"] if k != REST]
            out |= {f"{c}={k}": (level == k).cast("double") for k in named}
            if REST in p["levels"]:
                out[f"{c}={REST}"] = (~level.isin(*named)).cast("double")
    return df.select(*keep, *[v.alias(k) for k, v in out.items()]), list(out)


def predict(df: DataFrame, names: list[str], beta: np.ndarray) -> Column:
    """A linear score: intercept first."""
    return sum((F.col(f"`{c}`") * float(b) for c, b in zip(names, beta[1:])), F.lit(float(beta[0])))


def diagnose(df: DataFrame, plan: Plan, seed: int = 42, per_column: bool = True) -> dict:
    """The baseline over all usable rows: status, model, baseline, lift, t, signal, unstable, near_perfect, columns (scores of each alone), suspicious; a failure is a status too."""
    try:
        return _diagnose(df, plan, seed, per_column)
    except Exception as e:  # a measurement on the report must not take the report down
        return {"status": "unavailable", "reason": f"the baseline failed: {type(e).__name__}: {str(e)[:200]}"}


def _diagnose(df: DataFrame, plan: Plan, seed: int, per_column: bool) -> dict:
    from .prep import grouped_folds

    rows, classes = encode_target(usable_rows(df, plan), plan)
    n = rows.count()
    if n < MIN_ROWS:
        return {"status": "unavailable", "reason": f"{n} usable rows are too few"}
    if classes is not None and len(classes) < 2:
        return {"status": "unavailable", "reason": "one class only"}
    if plan.group_by:
        folded = grouped_folds(rows.withColumn("datassay_g", typed_key(rows, plan.group_by).cast("string")), "datassay_g").drop("datassay_g")
    elif classes is not None:
        from .prep import stratified_folds

        folded = stratified_folds(rows, "datassay_y", F.xxhash64(F.lit(seed), *[native(rows, c) for c in df.columns]))
    else:
        folded = plain_folds(rows, F.struct(*[F.col(f"`{c}`") for c in df.columns]), FOLDS, seed)
    folded = folded.persist()
    fitted = baseline.fit_folds(folded, plan.numeric, plan.categorical, plan.presence, FOLDS, per_column)
    if not (fitted.numbers or fitted.levels or fitted.presence):
        folded.unpersist()
        return {"status": "unavailable", "reason": "no column is left to learn from"}
    full, by_column = baseline.cross_validate(folded, fitted, len(classes) if classes is not None else None, 1.0, per_column)
    folded.unpersist()
    s, base = np.array(full).T
    lift = s - base
    var = lift.var(ddof=1) * (1 / len(s) + 1 / (len(s) - 1)) if len(s) > 1 else 0.0
    t = float(lift.mean() / math.sqrt(var)) if var > 0 else (math.inf if lift.mean() > 0 else 0.0)
    unstable = classes is None and float(base.min()) < UNSTABLE
    alone = [(c, float(np.mean([x for x, _ in own]))) for c, own in by_column.items()]
    alone.sort(key=lambda x: -x[1])
    return {
        "status": "ok", "task": plan.task, "metric": "r2" if classes is None else "balanced_accuracy", "rows": n, "folds": len(s), "split": f"grouped by {plan.group_by}" if plan.group_by else "random" if classes is None else "stratified",
        "model": float(s.mean()), "baseline": float(base.mean()), "lift": float(lift.mean()), "t": t, "unstable": unstable, "signal": None if unstable else bool(lift.mean() > 0 and t >= T_LIMIT),
        "near_perfect": bool(not unstable and s.mean() >= SUSPICIOUS), "columns": alone, "suspicious": [] if unstable else [c for c, v in alone if v >= SUSPICIOUS],
    }


def determinations(pairs: list, kept) -> dict[str, dict]:
    """The finer of two associated columns (V >= 0.6) with three times the levels determines the coarser: fine -> levels, rows, coarse. pairs: rows (a, b, v, n, r, c)."""
    out: dict[str, dict] = {}
    for p in pairs:
        if p["v"] is None or p["v"] < 0.6 or not (kept(p["a"]) and kept(p["b"])) or max(p["r"], p["c"]) < 3 * min(p["r"], p["c"]):
            continue
        fine, n, coarse, m = (p["a"], p["r"], p["b"], p["c"]) if p["r"] > p["c"] else (p["b"], p["c"], p["a"], p["r"])
        out.setdefault(fine, {"levels": n, "rows": p["n"], "coarse": []})["coarse"].append((coarse, m, p["v"]))
    return out
