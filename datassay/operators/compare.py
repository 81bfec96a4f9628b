"""Train against test: schema, copied rows, shared entities, dates, shift of the target and of every feature; findings and a verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import family, is_missing, native, number, to_cell
from . import drift
from .timechecks import date_values

# Bands of the population stability index, and shares that need attention.
MODERATE, MAJOR = 0.1, 0.25
UNSEEN, MISSING_SHIFT = 0.05, 10
NUMBER_SHARE, PER_ROW, SHARED = 0.8, 0.95, 0.05


def level_of(psi):
    return F.when(psi >= MAJOR, "major").when(psi >= MODERATE, "moderate").otherwise("stable")


def type_changes(test: DataFrame, numeric: list[str]) -> DataFrame:
    """(col, numeric_share): columns that are numbers in train and mostly none in test."""
    if not numeric:
        return test.sparkSession.createDataFrame([], "col string, numeric_share double")
    cell = lambda c: to_cell(test, c)
    shares = [F.struct(F.lit(c).alias("col"), F.try_divide(F.count_if(~is_missing(cell(c)) & number(cell(c)).isNotNull()), F.count_if(~is_missing(cell(c)))).alias("numeric_share")).alias(f"c{i}") for i, c in enumerate(numeric)]
    one = test.agg(*shares)
    return one.select(F.explode(F.array(*one.columns)).alias("s")).select("s.*").where(F.col("numeric_share") < NUMBER_SHARE)


def entities(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """(col, per_row, test_rows, in_train, share, level): values of an entity column on both sides; a value per row makes any repeat a blocker."""
    own = train.where(native(train, column).isNotNull()).groupBy(native(train, column).alias("v")).agg(F.count("*").alias("n")).agg(F.count("*").alias("d"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    both = drift.entity_overlap(train, test, column).crossJoin(F.broadcast(own))  # one row by one row
    per_row = F.col("d") >= PER_ROW * F.col("n")
    share = F.coalesce(F.try_divide(F.col("shared_rows"), F.col("test_rows")), F.lit(0.0))
    level = F.when(F.col("shared_rows") == 0, None).when(per_row, "blocker").when(share >= SHARED, "fix")
    return both.select(F.lit(column).alias("col"), per_row.alias("per_row"), "test_rows", F.col("shared_rows").alias("in_train"), share.alias("share"), level.alias("level"))


def date_ranges(train: DataFrame, test: DataFrame, column: str, day_first: bool = False) -> DataFrame:
    """(train_from, train_to, test_from, test_to, test_after_train, overlap)."""
    ends = lambda df, side: df.agg(F.min(date_values(df, column, day_first)).alias(f"{side}_from"), F.max(date_values(df, column, day_first)).alias(f"{side}_to"))
    both = ends(train, "train").crossJoin(F.broadcast(ends(test, "test")))  # one row by one row
    return both.withColumn("test_after_train", F.col("test_from") >= F.col("train_to")).withColumn("overlap", (F.col("test_from") <= F.col("train_to")) & (F.col("test_to") >= F.col("train_from")))


def class_shares(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """(class, train, test): each class's share on both sides, three digits."""
    both = drift._levels(train, column, "e").join(drift._levels(test, column, "a"), "k", "full")
    total = both.agg(F.sum("e").alias("n"), F.sum("a").alias("m"))
    share = lambda c, n: F.floor(F.coalesce(F.try_divide(F.coalesce(c, F.lit(0)), F.col(n)), F.lit(0.0)) * 1000 + 0.5) / 1000
    return both.crossJoin(F.broadcast(total)).select(F.col("k").alias("class"), share("e", "n").alias("train"), share("a", "m").alias("test"))  # one row


def feature_shift(train: DataFrame, test: DataFrame, column: str, numeric: bool) -> DataFrame:
    """(col, kind, psi, psi_raw, ks, p, unseen_share, unseen_count, level)."""
    none = F.lit(None).cast("double")
    if numeric:
        # Text is parsed; what is no number is left out.
        train, test = (df if family(df, column) in ("double", "bigint") else df.withColumn(column, number(to_cell(df, column))) for df in (train, test))
        one = drift.psi(drift.numeric_bins(train, test, column)).crossJoin(F.broadcast(drift.ks_two_sample(train, test, column).select("d", "p")))  # one row by one row
        out = one.select("psi", "psi_raw", F.col("d").alias("ks"), "p", none.alias("unseen_share"), F.lit(0).cast("bigint").alias("unseen_count"))
    else:
        lev = drift._levels(test, column, "m").join(drift._levels(train, column, "n"), "k", "left")
        unseen = lev.agg(F.coalesce(F.try_divide(F.sum(F.when(F.col("n").isNull(), F.col("m")).otherwise(0)), F.sum("m")), F.lit(0.0)).alias("unseen_share"), F.count_if(F.col("n").isNull()).alias("unseen_count"))
        out = drift.psi(drift.level_bins(train, test, column)).crossJoin(F.broadcast(unseen)).select("psi", "psi_raw", none.alias("ks"), none.alias("p"), "unseen_share", "unseen_count")
    return out.select(F.lit(column).alias("col"), F.lit("numeric" if numeric else "categorical").alias("kind"), "*", level_of(F.col("psi")).alias("level"))


def findings(facts: dict) -> tuple[str, list[tuple[str, str]]]:
    """(verdict, findings as (level, text)) from what compare() measured."""
    out: list[tuple[str, str]] = []
    quoted = lambda xs: ", ".join(f'"{x}"' for x in xs)
    if facts["missing_for_model"]:
        out.append(("blocker", f"the test table lacks what the model uses: {quoted(facts['missing_for_model'][:5])}"))
    if facts["type_changes"]:
        out.append(("blocker", f"numbers in train, text in test: {quoted(facts['type_changes'])}"))
    if facts["overlap"]:
        out.append(("blocker", f"{facts['overlap']} test rows are in train too"))
    out += [(e["level"], f"{e['in_train']} test rows share a {e['col']} with train") for e in facts["entities"] if e["level"]]
    dates = facts["dates"]
    if dates and dates["overlap"] and facts["recommend_time_split"]:
        out.append(("fix", "both tables cover the same period of data that change over time"))
    target = facts["target"]
    if target and target["labelled"] and target["level"] != "stable":
        out.append(("fix", f"the target is distributed differently (PSI {target['psi']:.2f})"))
    if major := [f for f in facts["features"] if f["level"] == "major"]:
        out.append(("fix", f"{len(major)} features are distributed very differently: {quoted(f['col'] for f in major[:4])}"))
    if unseen := [f for f in facts["features"] if (f["unseen_share"] or 0) >= UNSEEN]:
        out.append(("fix", f"categories that train never had: {quoted(f['col'] for f in unseen)}"))
    if moved := [r for r in facts["missing"] if r["shift"]]:
        out.append(("fix", f"missing shares changed: {quoted(r['col'] for r in moved)}"))
    if facts["only_test"] and not facts["missing_for_model"]:
        out.append(("note", f"the test table has columns of its own: {quoted(facts['only_test'][:5])}"))
    if target and not target["labelled"]:
        out.append(("note", "the test table has no target values"))
    if dates and dates["test_after_train"]:
        out.append(("note", "the test table is later than train"))
    rank = {"blocker": 0, "fix": 1, "note": 2}
    out.sort(key=lambda x: rank[x[0]])
    levels = {x[0] for x in out}
    return "blocked" if "blocker" in levels else "fix" if "fix" in levels else "ready", out


def compare(train: DataFrame, test: DataFrame, roles: dict[str, str], target: str | None = None, model: list[str] | None = None, identifiers: list[str] = (), date: str | None = None, recommend_time_split: bool = False) -> dict[str, DataFrame]:
    """Tables by name: schema, type_changes, overlap, entities, dates, target, shift, missing, findings. Roles are train's; small results only reach the driver."""
    spark = train.sparkSession
    shared = [c for c in train.columns if c in test.columns]
    only_test = [c for c in test.columns if c not in train.columns]
    sides = [(c, "both") for c in shared] + [(c, "train") for c in train.columns if c not in test.columns] + [(c, "test") for c in only_test]
    out = {"schema": spark.createDataFrame(sides, "col string, side string")}
    keep = lambda df: df.sparkSession.createDataFrame(df.collect(), df.schema)  # noqa: E731  a row a column at most
    out["type_changes"] = keep(type_changes(test, [c for c in shared if roles.get(c) == "numeric"]))
    changed = [r["col"] for r in out["type_changes"].collect()]
    rest = [c for c in shared if c != target]
    out["overlap"] = keep(drift.row_overlap(train, test, rest))
    found = [keep(entities(train, test, c)) for c in dict.fromkeys(identifiers) if c in shared and roles.get(c) != "temporal"]
    if found:
        out["entities"] = found[0]
        for f in found[1:]:
            out["entities"] = out["entities"].unionByName(f)
    if date and date in shared:
        out["dates"] = keep(date_ranges(train, test, date))
    goal = None
    if target and target in shared:
        labelled = not test.where(~is_missing(to_cell(test, target))).isEmpty()
        if labelled:
            numeric = roles.get(target) == "numeric"
            out["target"] = keep(feature_shift(train, test, target, numeric))
            if not numeric:
                out["classes"] = class_shares(train, test, target).orderBy(F.desc("train"), "class")
            goal = {"labelled": True} | out["target"].first().asDict()
        else:
            goal = {"labelled": False}
    features = [c for c in rest if roles.get(c) in ("numeric", "binary", "categorical") and (not model or c in model) and c not in changed]
    rows = [r for c in features for r in feature_shift(train, test, c, roles[c] == "numeric").collect()]
    if rows:
        out["shift"] = spark.createDataFrame(sorted(rows, key=lambda r: (-r["psi"], r["col"])), "col string, kind string, psi double, psi_raw double, ks double, p double, unseen_share double, unseen_count bigint, level string")
    out["missing"] = keep(drift.missing_shift(train, test, features)) if features else spark.createDataFrame([], "col string, train double, test double, shift boolean")
    facts = {
        "missing_for_model": [c for c in model or [] if c not in test.columns], "type_changes": changed, "overlap": out["overlap"].first()["copied"], "entities": out["entities"].collect() if found else [],
        "dates": out["dates"].first() if "dates" in out else None, "recommend_time_split": recommend_time_split, "target": goal, "features": rows, "missing": out["missing"].collect(), "only_test": only_test,
    }
    verdict, said = findings(facts)
    out["findings"] = spark.createDataFrame([(i, verdict, level, text) for i, (level, text) in enumerate(said)] or [(0, verdict, "note", "nothing found")], "seq int, verdict string, level string, finding string")
    return out
