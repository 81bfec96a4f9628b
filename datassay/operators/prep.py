"""Model preparation: folds, imputation, encoding, and a ridge baseline from one Gram aggregation a fold."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import key, to_cell
from ..functions.order import ordinals, searched

MAX_LEVELS = 20
SUSPICIOUS, UNSTABLE, T_LIMIT = 0.95, -1.0, 2.776


def stratified_folds(df: DataFrame, target: str, order: Column, k: int = 5) -> DataFrame:
    """df with fold: round robin over rows by class, then order (a number), the offset carried from class to class."""
    numbered = df.withColumn("datassay_o", order)
    placed = ordinals(numbered, F.col("datassay_o"), F.col("datassay_o"), [target], [F.col("datassay_o"), F.xxhash64(F.lit(1), *[F.col(f"`{c}`") for c in df.columns])])
    return placed.withColumn("fold", F.pmod(F.col("rn") - 1, F.lit(k)).cast("int")).select(*df.columns, "fold")


def plain_folds(df: DataFrame, order: Column, k: int = 5, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), order), F.lit(k)).cast("int"))


def dealt(load: list[int], size: int, groups: int) -> list[int]:
    """How many of `groups` groups of one size each fold gets, when every one goes to the lightest fold so far (the first of equal ones).

    A fold takes its j-th group at load + j * size; the groups go in the order of these loads, so a level of load says how many each fold has.
    """
    taken = lambda level: [max(0, -(-(level - x) // size)) for x in load]  # noqa: E731  those begun below the level
    low, high = min(load), max(load) + size * (groups + 1)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if sum(taken(mid)) <= groups else (low, mid)
    out = taken(low)
    for f, x in enumerate(load):  # those at the level itself, in the order of folds
        if sum(out) < groups and x + out[f] * size == low:
            out[f] += 1
    return out


def grouped_folds(df: DataFrame, group: str, k: int = 5, seed: int = 42) -> DataFrame:
    """df with fold, no group split: groups go largest first to the lightest fold. A row without a group is one of its own, with its equals.

    Sizes are dealt by how many groups have each (few numbers), so it takes the driver no group; groups of a size
    are then ranked by hash and cut at these numbers.
    """
    name = F.coalesce(F.concat(F.lit("="), to_cell(df, group)), F.concat(F.lit("?"), F.hex(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))))
    sizes = df.groupBy(name.alias("datassay_g")).agg(F.count("*").alias("n"))
    load, cuts = [0] * k, []
    upto = 0
    for r in sorted(sizes.groupBy("n").agg(F.count("*").alias("m")).collect(), key=lambda r: -r["n"]):
        for f, m in enumerate(dealt(load, r["n"], r["m"])):
            load[f] += m * r["n"]
            upto += m
            cuts.append(upto)
    tie = F.pmod(F.xxhash64(F.lit(seed), "datassay_g"), F.lit(1 << 52))
    ranked = ordinals(sizes, -F.col("n"), tie, [], [F.col("datassay_g")])
    folds = ranked.select("datassay_g", F.pmod(searched(F.col("rn").cast("double"), np.array(cuts, np.float64)), F.lit(k)).cast("int").alias("fold"))
    return df.withColumn("datassay_g", name).join(folds, "datassay_g").select(*df.columns, "fold")


def impute(df: DataFrame, how: dict[str, str]) -> DataFrame:
    """df with missing cells filled by median, mean or most_frequent (ties to the smaller), and <col>__missing flags."""
    aggs, middle = [F.count("*").alias("datassay_n")], {str(i): c for i, (c, kind) in enumerate(how.items()) if kind == "median"}
    for c, kind in how.items():
        x = F.col(f"`{c}`")
        if kind != "median":
            aggs.append({"mean": F.avg(x), "most_frequent": F.expr(f"mode() within group (order by `{c}`)")}[kind].alias(c))
    fill = df.agg(*aggs).first().asDict()
    if middle:
        from .stats import quantiles

        each = F.explode(F.array(*[F.struct(F.lit(i).alias("col"), F.col(f"`{c}`").cast("double").alias("num")) for i, c in middle.items()])).alias("e")
        nums = df.select(each).select("e.*").where("num is not null").groupBy("col", "num").agg(F.count("*").alias("n"))
        fill |= dict.fromkeys(middle.values()) | {middle[r["col"]]: r["m"] for r in quantiles(nums, {"m": 0.5}).collect()}
    out = df
    for c in how:
        out = out.withColumn(f"{c}__missing", F.col(f"`{c}`").isNull())
    return out.fillna({c: fill[c] for c in how if fill[c] is not None})


def one_hot(df: DataFrame, column: str, levels: int = MAX_LEVELS) -> DataFrame:
    """df with a 0/1 column for each frequent level (by count, ties by level) and, if there are more, one for the rest; unseen values are all zero."""
    k = key(to_cell(df, column))
    top = df.select(k.alias("k")).where("k is not null").groupBy("k").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(levels + 1).collect()
    names = [r["k"] for r in top[: levels if len(top) <= levels else levels - 1]]
    out = df.select("*", *[F.coalesce((k == n).cast("int"), F.lit(0)).alias(f"{column}={n}") for n in names])
    return out if len(top) <= levels else out.withColumn(f"{column}=(infrequent)", (k.isNotNull() & ~k.isin(*names)).cast("int"))


def gram(df: DataFrame, features: list[str], target: str, weight: Column | None = None, by: str | None = None) -> dict:
    """{group: (sum of weights, X'X and X'y of [1, features] with the target last)}: one aggregation, whatever the rows."""
    w = weight if weight is not None else F.lit(1.0)
    cols = [F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in features], F.col(f"`{target}`").cast("double")]
    ok = F.lit(True)
    for c in cols[1:]:
        ok = ok & c.isNotNull()
    aggs = [F.sum(w * cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    rows = df.where(ok).groupBy(*([by] if by else [])).agg(*aggs).collect()
    out = {}
    for r in rows:
        m = np.zeros((len(cols), len(cols)))
        for i in range(len(cols)):
            for j in range(i, len(cols)):
                m[i, j] = m[j, i] = r[f"s{i}_{j}"] or 0.0
        out[r[by] if by else None] = m
    return out


def solve(m: np.ndarray, alpha: float) -> np.ndarray:
    """[intercept, weights] of ridge regression from a Gram matrix: centred, the intercept not penalised."""
    n, d = m[0, 0], len(m) - 2
    sx, sy = m[0, 1 : d + 1], m[0, -1]
    a = m[1 : d + 1, 1 : d + 1] - np.outer(sx, sx) / n + alpha * np.eye(d)
    w = np.linalg.solve(a, m[1 : d + 1, -1] - sx * sy / n)
    return np.append(sy / n - sx @ w / n, w)


def ridge(df: DataFrame, features: list[str], target: str, alpha: float = 1.0, weight: Column | None = None) -> DataFrame:
    """(term, value)."""
    m = gram(df, features, target, weight).get(None)
    if m is None or not m[0, 0]:
        return df.sparkSession.createDataFrame([], "term string, value double")
    b = solve(m, alpha)
    return df.sparkSession.createDataFrame([("(intercept)", float(b[0])), *[(c, float(v)) for c, v in zip(features, b[1:])]], "term string, value double")


def cross_validate(df: DataFrame, features: list[str], target: str, k: int = 5, alpha: float = 1.0, seed: int = 42) -> DataFrame:
    """(score, baseline, lift, t, signal, unstable, suspicious): R2 over k folds, all rows.

    Every fold's Gram matrix comes from one aggregation; a training set's is the sum of the others', and a test
    fold's errors follow from its own, so the rows are read once. t is corrected for overlapping training sets.
    """
    order = F.struct(*[F.col(f"`{c}`") for c in (*features, target)])
    parts = gram(plain_folds(df, order, k, seed), features, target, by="fold")
    total = sum(parts.values()) if parts else None
    scores = []
    for m in parts.values():
        rest = total - m
        if m[0, 0] < 2 or rest[0, 0] < 2:
            continue
        b = np.append(solve(rest, alpha), -1.0)
        sse = float(b @ m @ b)
        mean = m[0, -1] / m[0, 0]
        sst = m[-1, -1] - m[0, 0] * mean * mean
        scores.append((1 - sse / sst if sst > 0 else 0.0, 1 - (sst + m[0, 0] * (mean - rest[0, -1] / rest[0, 0]) ** 2) / sst if sst > 0 else 0.0))
    schema = "score double, baseline double, lift double, t double, signal boolean, unstable boolean, suspicious boolean"
    if len(scores) < 2:
        return df.sparkSession.createDataFrame([], schema)
    s, base = np.array(scores).T
    lift = s - base
    var = lift.var(ddof=1) * (1 / len(s) + 1 / (len(s) - 1))
    t = lift.mean() / math.sqrt(var) if var > 0 else (math.inf if lift.mean() > 0 else 0.0)
    row = (float(s.mean()), float(base.mean()), float(lift.mean()), float(t), bool(lift.mean() > 0 and t >= T_LIMIT), bool(base.min() < UNSTABLE), bool(s.mean() >= SUSPICIOUS))
    return df.sparkSession.createDataFrame([row], schema)


def plan(roles: DataFrame, leaks: list[str], target: str | None) -> DataFrame:
    """(col, treatment, reason): what becomes of each column, by the first rule that fits; from a profile with roles."""
    share = F.col("missing") / F.col("rows") * 100
    leaking = F.col("col").isin(*leaks) if leaks else F.lit(False)
    treatment = (
        F.when(F.col("role") == "identifier", "exclude").when(leaking, "exclude").when((F.col("present") == 0) | (F.col("distinct_raw") == 1) & (F.col("missing") == 0), "exclude")
        .when((share > 50) | (F.col("distinct_raw") == 1), "presence").when(F.col("role").isin("temporal", "text"), "exclude").when((F.col("role") == "categorical") & (F.col("present") / F.greatest("distinct", F.lit(1)) < 5), "exclude")
        .when(F.col("role") == "numeric", F.when(share > 20, "numeric+flag").otherwise("numeric")).otherwise(F.when(share > 20, "categorical+flag").otherwise("categorical"))
    )
    reason = F.when(F.col("role") == "identifier", "identifier").when(leaking, "leak").when(F.col("present") == 0, "empty").when((F.col("distinct_raw") == 1) & (F.col("missing") == 0), "constant").when(share > 50, "mostly missing").when(F.col("distinct_raw") == 1, "constant with gaps").when(F.col("role").isin("temporal", "text"), F.col("role")).when((F.col("role") == "categorical") & (F.col("present") / F.greatest("distinct", F.lit(1)) < 5), "too fine")
    return roles.where(F.col("col") != F.lit(target or "")).select("col", "role", treatment.alias("treatment"), reason.alias("reason"))
