"""Whole analyses: profile(), compare(), prepare(), diagnose(), clean(), report(). Each gives a catalogue of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import advice, assoc, claims, cleaning, groups, model, prep, relations, score, stats, timechecks
from ..operators import compare as sides
from ..operators import profile as prof
from ..operators.temporal import temporal_columns
from ..sources import exports

BASELINE = "status string, reason string, task string, metric string, rows bigint, folds int, split string, model double, baseline double, lift double, t double, unstable boolean, signal boolean, near_perfect boolean, suspicious array<string>, columns array<struct<col: string, score: double>>"


def override(roles: dict[str, str], wanted: dict[str, str] | None) -> tuple[dict[str, str], dict[str, tuple[str, str]]]:
    """(roles, {column: (from, to)}): known columns and roles only."""
    changed = {c: (roles[c], r) for c, r in (wanted or {}).items() if c in roles and r in claims.ROLES and roles[c] != r}
    return roles | {c: r for c, (_, r) in changed.items()}, changed


def profile(df: DataFrame, target: str | None = None, overrides: dict[str, str] | None = None, baseline: bool = True) -> dict[str, DataFrame]:
    """Tables by name: profile, quality, duplicates, balance, levels, statistics, matrix, strong, associations, unscored, presence,
    categorical, same_target, plan, baseline, recommendations, insights, observations, readiness, health, overrides, time.

    baseline: a model is fitted by the plan, over all rows; readiness and health rest on what it shows. The other tables don't. The frequency table is cached while the analysis runs: all per-column results read it. Only rows per column, pair, class or finding
    reach the driver, and come back as small tables.
    """
    spark = df.sparkSession
    counts = prof.value_counts(df).persist()
    keep = lambda x: spark.createDataFrame(x.collect(), x.schema)  # noqa: E731  a row a column, pair or class
    base = prof.column_profile(counts)
    table = prof.roles(base, temporal_columns(counts), prof.identifiers(base, prof.identifier_shapes(counts)), target=target)
    rows = sorted(table.collect(), key=lambda r: r["pos"])
    roles, changed = override({r["col"]: r["role"] for r in rows}, overrides)
    table = spark.createDataFrame([r.asDict() | {"role": roles[r["col"]]} for r in rows], table.schema)
    rows = sorted(table.collect(), key=lambda r: r["pos"])
    total = rows[0]["rows"] if rows else 0
    out = {"profile": table, "quality": keep(prof.quality_flags(table)), "overrides": spark.createDataFrame([(c, *v) for c, v in changed.items()], "col string, was string, is string")}
    dup = keep(prof.duplicate_rows(df))
    duplicates = dup.first()["duplicates"]
    out["duplicates"], out["quality_score"] = dup, keep(prof.quality_score(table, dup))
    out["levels"] = keep(prof.top_levels(counts))
    numeric = [c for c, r in roles.items() if r == "numeric"]
    if numeric:
        out["statistics"] = stats.statistics(counts, numeric)
    features = [c for c in numeric if c != target]
    pairs: list[tuple[str, str, float]] = []
    curved: list[tuple[str, str, float, float]] = []
    linked: list[str] = []
    if len(features) > 1:
        wide = assoc.frame(df, features)
        out["matrix"] = keep(assoc.matrix(wide, features))
        out["strong"] = keep(relations.strong_pairs(out["matrix"], keep(relations.spearman_matrix(wide, features))))
        pairs = [(r["a"], r["b"], r["r"]) for r in out["matrix"].collect() if abs(r["r"]) >= 0.7]
        curved = [(r["a"], r["b"], r["r"], r["rho"]) for r in out["strong"].where("monotonic_not_linear").collect()]
        linked = [r["col"] for r in assoc.clusters(out["matrix"]).orderBy("col").collect()]
    leaks: list[str] = []
    got: list = []
    best = None
    goal = next((r for r in rows if r["col"] == target), None)
    categorical = [c for c, r in roles.items() if r in ("binary", "categorical") and c != target]
    tied: list = []
    if len(categorical) > 1:
        out["categorical"] = keep(relations.categorical_pairs(df, categorical))
        tied = out["categorical"].collect()
    if target:
        out["associations"] = relations.target_associations(df, roles, target)
        got = out["associations"].collect()
        gappy = [r["col"] for r in rows if r["col"] != target and roles[r["col"]] not in relations.SKIPPED and 0 < r["missing"] < r["rows"]]
        filled = {r["col"]: r["v"] for r in relations.presence_signals(df, gappy, target).collect()} if gappy else {}
        out["presence"] = spark.createDataFrame(sorted(filled.items(), key=lambda x: -x[1]), "col string, v double")
        out["unscored"] = relations.unscored(df, roles, target, out["associations"], filled)
        leaks = list(dict.fromkeys([r["col"] for r in got if r["suspect"]] + [c for c, v in filled.items() if v >= relations.LEAK]))
        best = max((r["abs_value"] for r in got if r["abs_value"] is not None), default=None)
        out["observations"] = spark.createDataFrame(relations.observations(got, total, target), "kind string, text string")
        repeated = [c for c, r in roles.items() if c != target and r != "text"]
        out["same_target"] = keep(groups.same_target_values(df, repeated, target).where("gain >= 0.9"))
    classes = keep(prof.class_balance(counts, target)).collect() if target and roles.get(target) in ("binary", "categorical") else []
    if classes:
        out["balance"] = spark.createDataFrame(classes)
    own = model_plan(rows, roles, leaks, target, out.get("statistics"), tied, duplicates, classes)
    out["plan"] = plan_table(rows, roles, leaks, target, own, tied, spark)
    found = fitted_baseline(df, own) if target and baseline else None
    if found:
        out["baseline"] = spark.createDataFrame([found], BASELINE)
    conflicts = None
    if target:
        parts = [c for c in roles if c != target and roles[c] != "identifier"]
        out["conflicts"] = keep(groups.label_conflicts(df, parts, target))
        conflicts = (out["conflicts"].first()["conflict_rows"], total)
    personal = [r["col"] for r in cleaning.personal_columns(counts.where(~F.col("col").isin(*numeric)) if numeric else counts).collect()]
    flags = out["quality"].collect()
    mixed, fine = [r["col"] for r in flags if r["mixed_numeric"]], [r["col"] for r in flags if r["high_cardinality"]]
    dates = [c for c, r in roles.items() if r == "temporal"]
    when = timechecks.time_checks(df, dates, roles, target, counts) if dates else None
    if when:
        out["time"] = spark.createDataFrame([(when["column"], when["future"], when["cutoff"], when["recommend_time_split"], when["late"].count())], "column string, future bigint, cutoff timestamp, recommend_time_split boolean, late_columns bigint")
    counts.unpersist()
    empty = [r["col"] for r in rows if r["rows"] and r["missing"] / r["rows"] >= 0.5]
    excluded = [r["col"] for r in out["plan"].collect() if r["treatment"] == "exclude"]
    smallest = min((r["n"] for r in classes if r["label"] != "(missing)"), default=None)
    imbalanced = bool(classes and classes[0]["imbalanced"])
    top = {r["col"]: r["share"] for r in out["levels"].collect() if r["rank"] == 1}
    majority = max((r["pct"] for r in classes if r["label"] != "(missing)"), default=None) if imbalanced else None
    described = out["statistics"].collect() if numeric else []
    recs = score.recommendations(rows, leaks, duplicates, total, target, pairs, described, top, got, majority, curved, tied)
    out["recommendations"] = spark.createDataFrame(recs, "seq int, priority string, category string, col string, action string")
    kind = score.dataset_type(roles.get(target), goal["distinct"] if goal else 0, bool(goal and goal["distinct_raw"] < 2), bool(goal and goal["role"] == "identifier"))
    cards = advice.insights(rows, leaks, duplicates, target, described, pairs, got, classes, imbalanced, fine, linked, kind)
    out["insights"] = spark.createDataFrame([(i, *c) for i, c in enumerate(cards)], "seq int, severity string, score double, title string, subject string")
    entities = [r["col"] for r in out["same_target"].orderBy("col").collect() if r["col"] not in leaks and roles[r["col"]] != "temporal"] if target else []
    verdict, findings = score.readiness(total, target, goal, leaks, duplicates, conflicts, smallest, imbalanced, personal, mixed, empty, excluded, when, found, entities, own.group_by if own else None)
    out["readiness"] = spark.createDataFrame([(i, verdict, level, text) for i, (level, text) in enumerate(findings)] or [(0, verdict, "note", "nothing found")], "seq int, verdict string, level string, finding string")
    quality = out["quality_score"].first()["score"]
    structure = score.structure_score(table).first()["structure"]
    value, _ = score.health(
        quality, structure, total, len(pairs), best, bool(leaks), goal["missing"] / total * 100 if goal and total else None, imbalanced, max((r["pct"] for r in classes), default=0.0),
        bool(target and roles.get(target) == "numeric"), max((r["missing"] / r["rows"] * 100 for r in rows if r["rows"]), default=0.0), bool(goal and goal["distinct_raw"] < 2), bool(goal and goal["role"] == "identifier"),
    )
    value = score.diagnostic_caps(value, found)
    grade = score.grade(value)
    out["health"] = spark.createDataFrame([(value, grade, int(quality), float(structure))], "score int, grade string, quality int, structure double")
    return out


def fitted_baseline(df: DataFrame, plan: model.Plan | None) -> dict:
    """What model.diagnose() says of the plan."""
    return model.diagnose(df, plan) if plan and plan.features else {"status": "unavailable", "reason": "no target or no feature"}


def model_plan(rows: list, roles: dict[str, str], leaks: list[str], target: str | None, statistics: DataFrame | None, tied: list, duplicates: int, classes: list) -> model.Plan | None:
    """The plan a model is fitted by; none without a target that can be learned."""
    goal = next((r for r in rows if r["col"] == target), None)
    if goal is None or roles[target] not in relations.MEASURED or goal["distinct_raw"] < 2:
        return None
    said = advice.decisions(rows, leaks, target)
    skew = {r["col"]: r["skew"] for r in statistics.collect()} if statistics is not None else {}
    thin = too_fine(tied, said)
    plan = model.Plan(target, "regression" if roles[target] == "numeric" else "classification", group_by=next(iter(thin), None), drop_duplicates=duplicates > 0)
    for r in rows:
        c = r["col"]
        if c == target or c in said["dropped"] | said["leaking"] or c in thin and c not in said["replaced"]:
            continue
        flag = score.share_pct(r["missing"], r["rows"]) > 20
        if c in said["replaced"]:
            plan.presence.append(c)
        elif roles[c] == "numeric":
            plan.numeric[c] = (model.impute_strategy("numeric", skew.get(c)), flag)
        elif roles[c] in ("categorical", "binary"):
            plan.categorical[c] = flag
    plan.stratify = plan.task == "classification" and not plan.group_by and all(c["n"] >= 2 for c in classes)
    return plan


def too_fine(tied: list, said: dict[str, set[str]]) -> dict[str, dict]:
    """Columns with fewer than five rows a level that determine others, the finest first."""
    found = model.determinations(tied, lambda c: c not in said["not_kept"])
    return dict(sorted(((c, d) for c, d in found.items() if d["rows"] / d["levels"] < 5), key=lambda x: -x[1]["levels"]))


def plan_table(rows: list, roles: dict[str, str], leaks: list[str], target: str | None, plan: model.Plan | None, tied: list, spark) -> DataFrame:
    """(col, role, treatment, reason): what becomes of each column, by the first rule that fits."""
    said = advice.decisions(rows, leaks, target)
    thin = too_fine(tied, said)
    out = []
    for r in rows:
        c, role = r["col"], roles[r["col"]]
        if c == target:
            continue
        flag = "+flag" if score.share_pct(r["missing"], r["rows"]) > 20 else ""
        if role == "identifier":
            out.append((c, role, "exclude", "identifier"))
        elif c in said["leaking"]:
            out.append((c, role, "exclude", "leak"))
        elif c in said["dropped"]:
            out.append((c, role, "exclude", "empty or constant"))
        elif c in said["replaced"]:
            out.append((c, role, "presence", "mostly missing" if r["distinct_raw"] > 1 else "constant with gaps"))
        elif role in ("temporal", "text"):
            out.append((c, role, "exclude", role))
        elif c in thin:
            out.append((c, role, "exclude", "too fine" + (", groups the split" if plan and c == plan.group_by else "")))
        else:
            out.append((c, role, ("numeric" if role == "numeric" else "categorical") + flag, None))
    return spark.createDataFrame(out, "col string, role string, treatment string, reason string")


def plan_of(result: dict[str, DataFrame], target: str) -> model.Plan | None:
    """The fitted-model plan of a profile() result."""
    rows = sorted(result["profile"].collect(), key=lambda r: r["pos"])
    leaks = [r["col"] for r in result["plan"].collect() if r["reason"] == "leak"]
    tied = result["categorical"].collect() if "categorical" in result else []
    classes = result["balance"].collect() if "balance" in result else []
    return model_plan(rows, {r["col"]: r["role"] for r in rows}, leaks, target, result.get("statistics"), tied, result["duplicates"].first()["duplicates"], classes)


def compare(train: DataFrame, test: DataFrame, target: str | None = None, result: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """operators.compare.compare() under the roles, plan and dates of train's profile(), which is made where it is not given."""
    result = result or profile(train, target, baseline=False)
    rows = sorted(result["profile"].collect(), key=lambda r: r["pos"])
    roles = {r["col"]: r["role"] for r in rows}
    plan = plan_of(result, target) if target else None
    when = result["time"].first() if "time" in result else None
    ids = [c for c, r in roles.items() if r == "identifier"] + ([r["col"] for r in result["same_target"].collect()] if "same_target" in result else []) + ([plan.group_by] if plan and plan.group_by else [])
    return sides.compare(train, test, roles, target, plan.features if plan else None, ids, when["column"] if when else next((c for c, r in roles.items() if r == "temporal"), None), bool(when and when["recommend_time_split"]))


def prepare(df: DataFrame, plan: model.Plan, train: DataFrame | None = None) -> DataFrame:
    """df under a plan fitted on train (df itself, where none is given): one column an output, and the target as datassay_y."""
    parts = model.fit(model.usable_rows(train if train is not None else df, plan), plan)
    rows, _ = model.encode_target(df, plan)
    return model.transform(rows, parts, ["datassay_y"])[0]


def diagnose(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """The cross-validated baseline of number columns, over all rows."""
    return prep.cross_validate(df, features, target)


def diagnosed(df: DataFrame, result: dict[str, DataFrame], target: str) -> dict:
    """The baseline under the plan of a profile(), with the health score that it leaves."""
    if "baseline" in result:
        found = {k: v for k, v in result["baseline"].first().asDict(True).items() if v is not None or k == "signal"}
        if "columns" in found:
            found["columns"] = [(c["col"], c["score"]) for c in found["columns"]]
    else:
        found = fitted_baseline(df, plan_of(result, target))
    return found | {"health": score.diagnostic_caps(result["health"].first()["score"], found)}


def clean(df: DataFrame, rules: list[dict]) -> DataFrame:
    return cleaning.clean(df, rules)


def report(result: dict[str, DataFrame], name: str, kind: str = "markdown", target: str | None = None) -> str:
    """A report of the result tables as markdown, html or json."""
    if kind == "json":
        return exports.to_json(result, name)
    shown = exports.report_model(result, name, target)
    return exports.to_html(shown) if kind == "html" else exports.to_markdown(shown)
