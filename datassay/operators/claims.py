"""Claims about a table held against its data: leaks, formulas, splits, column descriptions; scores of answers against expectations.

Claims come as rows or dicts, from people or models; nothing here asks anyone. What can be measured is measured, the rest is a question.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cells import clip, half_up, is_missing, number, to_cell, typed_key
from . import assoc
from .cleaning import mask_personal
from .groups import formula_check, group_purity

# What a leak can be, and when the engine's own measure says so.
CATEGORIES = ("derived_from_target", "group_leak", "restates_label", "recorded_after_outcome")
OPERATIONS = ("sum", "difference", "product", "ratio")
CONFIRMED, WEAK = 0.95, 0.3
ROLES = ("identifier", "numeric", "binary", "categorical", "temporal", "text")


def parse_answer(text: str):
    """JSON with or without a code fence around it; null if it is none."""
    body = re.sub(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "", text)
    try:
        return json.loads(body)
    except ValueError:
        return None


def group_leak(df: DataFrame, group: str, target: str, numeric: bool) -> dict:
    """rows, repeated_share, and purity with its baseline, or rank eta over repeated groups for a numeric target."""
    one = group_purity(df, group, target).first()
    out = {"rows": one["rows"] or 0, "repeated_share": (one["repeated_rows"] or 0) / one["rows"] if one["rows"] else 0.0, "purity": None, "baseline": None, "eta": None}
    if not one["repeated_rows"]:
        return out
    if numeric:
        keyed = df.select(typed_key(df, group).alias("g"), number(to_cell(df, target)).alias("x")).where("g is not null and x is not null")
        many = keyed.groupBy("g").agg(F.count("*").alias("m")).where("m > 1").select("g")
        return out | {"eta": assoc.rank_eta(keyed.join(many, "g", "left_semi").select("x", "g"), "x", "g").first()["effect"]}
    return out | {"purity": one["purity"], "baseline": one["base"]}


def verify_leaks(df: DataFrame, found: list[dict], roles: dict[str, str], target: str, associations: dict[str, float], suspects: list[str], same_target: list[str] = ()) -> dict[str, DataFrame]:
    """findings (column, category, verdict, measure), withheld (column, reason), engine_only and not_raised (column).

    found: {column, category, and for a formula op and terms}. A formula is evaluated on every row; a group leak is a purity above
    its baseline; a restated label is the engine's own association; what was recorded later can't be measured and is a question.
    """
    spark = df.sparkSession
    findings, withheld, seen = [], [], set()
    for f in found:
        c, kind = f.get("column"), f.get("category")
        if c not in roles:
            withheld.append((str(c), "not a column of this table"))
        elif c == target:
            withheld.append((c, "is the target itself"))
        elif kind not in CATEGORIES:
            withheld.append((c, f"no category {kind!r}"))
        elif (c, kind) not in seen:
            seen.add((c, kind))
            measure, verdict = None, "question"
            if kind == "derived_from_target":
                result, terms = f.get("result", target), [t for t in f.get("terms", []) if t in roles]
                if f.get("op") not in OPERATIONS or len(terms) < 2 or len(terms) != len(f.get("terms", [])) or result not in roles:
                    verdict = "unchecked"
                else:
                    measure = formula_check(df, result, f["op"], terms).first()["share"]
                    verdict = "confirmed" if measure >= CONFIRMED else "partial" if measure >= 0.5 else "contradicted"
            elif kind == "group_leak":
                m = group_leak(df, c, target, roles[target] == "numeric")
                measure = m["eta"] if roles[target] == "numeric" else m["purity"]
                gain = 0.0 if measure is None else measure if m["baseline"] is None else (measure - m["baseline"]) / max(1e-9, 1 - m["baseline"])
                verdict = "contradicted" if not m["repeated_share"] else "confirmed" if gain >= 0.5 else "partial" if gain >= 0.1 else "contradicted"
            elif kind == "restates_label":
                measure = associations.get(c)
                verdict = "unchecked" if measure is None else "confirmed" if measure >= CONFIRMED else "partial" if measure >= WEAK else "contradicted"
            findings.append((c, kind, verdict, None if measure is None else float(measure), c in suspects))
    told = {f[0] for f in findings}
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "findings": one(findings, "column string, category string, verdict string, measure double, flagged boolean"),
        "withheld": one(withheld, "column string, reason string"),
        "engine_only": one([(c,) for c in suspects if c not in told], "column string"),
        "not_raised": one([(c,) for c in same_target if c not in told], "column string"),
    }


def verify_split(split: dict, roles: dict[str, str], df: DataFrame) -> tuple[str, str]:
    """(verdict, reason) of a proposed split {strategy: random, group or time; column}."""
    kind, c = split.get("strategy"), split.get("column")
    if kind == "random":
        return "unchecked", "nothing to measure"
    if kind not in ("group", "time") or c not in roles:
        return "withheld", "no such strategy or column"
    if kind == "time":
        return ("confirmed", "a date column") if roles[c] == "temporal" else ("contradicted", "not a date column")
    rows = df.where(typed_key(df, c).isNotNull()).agg(F.count("*").alias("n"), F.count_distinct(typed_key(df, c)).alias("d")).first()
    return ("confirmed", "rows share values") if rows["d"] < rows["n"] else ("contradicted", "every value is on one row")


def relevant(associations: dict[str, float], column: str, presence: dict[str, float]) -> bool:
    """Whether a column that is said to leak has any measured tie to the target."""
    return max(associations.get(column, 0.0), presence.get(column, 0.0)) >= WEAK


def column_facts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, present, numbers, distinct, whole): distinct counts to 3, which stands for more than two; whole: only whole numbers from 0 on."""
    each = F.array(*[F.struct(F.lit(c).alias("col"), F.when(~is_missing(to_cell(df, c)), to_cell(df, c)).alias("x")) for c in columns])
    counts = df.select(F.explode(each).alias("e")).select("e.*").where("x is not null").groupBy("col", "x").agg(F.count("*").alias("n")).withColumn("v", number(F.col("x")))
    v, n = F.col("v"), F.col("n")
    return counts.groupBy("col").agg(F.sum("n").alias("present"), F.sum(F.when(v.isNotNull(), n).otherwise(0)).alias("numbers"), F.least(F.count("*"), F.lit(3)).alias("distinct"), F.bool_and(F.coalesce((v >= 0) & (v == F.floor(v)), F.lit(False))).alias("whole"))


def outside(df: DataFrame, column: str, low: float | None, high: float | None) -> DataFrame:
    """(outside): numbers out of a closed range; a bound may be missing."""
    x = number(to_cell(df, column))
    no = F.lit(False)
    return df.agg(F.count_if((x < low if low is not None else no) | (x > high if high is not None else no)).alias("outside"))


def dossier_profile(counts: DataFrame, profile: DataFrame, levels_most: int = 20, top: int = 8, examples: int = 5) -> DataFrame:
    """(col, missing_pct, distinct, numeric_share, all_integers, top, examples, odd): what is told of a column without its rows; personal data masked.

    counts: value_counts(), profile: its profile. top: the commonest values of columns with few levels; examples: values at even strides of
    the sorted levels; odd: cells of a mostly numeric column that are none.
    """
    p = counts.where(~F.col("missing"))
    shown = clip(mask_personal(F.col("raw")))
    ranked = p.withColumn("i", F.row_number().over(Window.partitionBy("col").orderBy(F.desc("n"), "raw"))).where(F.col("i") <= top)
    tops = ranked.groupBy("col").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", shown.alias("v"), "n"))), lambda s: F.struct(s["v"].alias("value"), s["n"].alias("n"))).alias("top"))
    size = p.groupBy("col").agg(F.count("*").alias("d"))
    # Evenly spread by hash order, so that no column is sorted in one task.
    spread = p.withColumn("h", F.xxhash64("raw")).withColumn("i", F.row_number().over(Window.partitionBy("col").orderBy("h"))).where(F.col("i") <= examples)
    some = spread.groupBy("col").agg(F.array_sort(F.collect_list(shown)).alias("examples"))
    odd = p.where("num is null").withColumn("i", F.row_number().over(Window.partitionBy("col").orderBy(F.desc("n"), "raw"))).where("i <= 3").groupBy("col").agg(F.array_sort(F.collect_list(shown)).alias("odd"))
    out = profile.join(size, "col", "left").join(tops, "col", "left").join(some, "col", "left").join(odd, "col", "left")
    share = F.coalesce(F.try_divide(F.col("numeric"), F.col("present")), F.lit(0.0))
    text = F.col("role") == "text" if "role" in profile.columns else F.lit(False)
    return out.select(
        "col", half_up(100 * F.col("missing") / F.col("rows"), 1).alias("missing_pct"), F.when(F.col("distinct") > 20_000, ">20000").otherwise(F.col("distinct").cast("string")).alias("distinct"), share.alias("numeric_share"), "all_integers",
        F.when((F.col("distinct") <= levels_most) & ~text, F.col("top")).alias("top"), F.when(~text, F.col("examples")).alias("examples"), F.when((share > 0.5) & (share < 1), F.col("odd")).alias("odd"),
    )


#: Columns that a part of a payload tells of.
PART_COLUMNS = 25


def payload_parts(payload: DataFrame, order: str = "pos", most: int = PART_COLUMNS) -> DataFrame:
    """payload (a row a column) with part and parts, both from 1: so many columns in the table's order each. Rows are columns, so few."""
    place = F.row_number().over(Window.orderBy(order)) - 1
    total = F.count("*").over(Window.partitionBy())
    return payload.withColumn("part", (F.floor(place / most) + 1).cast("int")).withColumn("parts", F.ceil(total / most).cast("int"))


def merged_answers(answers: list[dict | None]) -> dict:
    """One answer from those to the parts: columns and rules one after the other, target candidates by rank, all firsts before all seconds, the first row grain."""
    told = [a for a in answers if a]
    lists = [a["target_candidates"] for a in told if isinstance(a.get("target_candidates"), list)]
    longest = max(map(len, lists), default=0)
    together = lambda k: [x for a in told if isinstance(a.get(k), list) for x in a[k]]
    return {"row_grain": next((a["row_grain"] for a in told if a.get("row_grain")), ""), "columns": together("columns"), "target_candidates": [own[i] for i in range(longest) for own in lists if i < len(own)], "rules": together("rules")}


def verify_dossier(claims: list[dict], roles: dict[str, str], facts: DataFrame, df: DataFrame) -> DataFrame:
    """(col, claim, verdict): described roles, ranges and target candidates against the data. claims: {name, role, min, max, target, evidence}."""
    known = {r["col"]: r for r in facts.collect()}
    out = []
    for c in claims:
        name = c.get("name")
        if name not in roles:
            out.append((str(name), "column", "withheld"))
            continue
        f = known.get(name)
        if c.get("role") is not None:
            ok = c["role"] in ROLES and not (c["role"] == "numeric" and f and f["numbers"] < 0.5 * f["present"]) and not (c["role"] == "binary" and f and f["distinct"] > 2)
            out.append((name, "role", "accepted" if ok else "contradicted" if c["role"] in ROLES else "withheld"))
        if c.get("min") is not None or c.get("max") is not None:
            n = outside(df, name, c.get("min"), c.get("max")).first()["outside"]
            out.append((name, "range", "accepted" if n == 0 else "contradicted"))
        if c.get("evidence"):
            there = not df.where(to_cell(df, name).contains(str(c["evidence"]))).isEmpty()
            out.append((name, "evidence", "accepted" if there else "withheld"))
        if c.get("target"):
            out.append((name, "target", "accepted" if roles[name] in ("numeric", "binary", "categorical") and f and f["distinct"] >= 2 else "withheld"))
    return df.sparkSession.createDataFrame(out, "col string, claim string, verdict string")


def review_payload(profile: DataFrame, candidates: DataFrame) -> DataFrame:
    """(col, role, present, affixes): columns with their dirty candidates, examples masked. candidates: cleaning.affixes()."""
    by = candidates.groupBy("col").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), clip(mask_personal(F.col("affix"))).alias("affix"), "n"))).alias("affixes"))
    return profile.join(F.broadcast(by), "col", "left").select("col", "role", "present", F.transform("affixes", lambda s: F.struct(s["affix"].alias("affix"), s["n"].alias("n"))).alias("affixes"))


def score_answers(expected: DataFrame, answered: DataFrame) -> DataFrame:
    """(key, expected, answered, hit): expectations (key, value) with their answers, right when equal without case, or numbers within 2 %."""
    both = expected.select("key", F.col("value").alias("expected")).join(answered.select("key", F.col("value").alias("answered")), "key", "left")
    a, b = number(F.col("answered").cast("string")), number(F.col("expected").cast("string"))
    close = F.abs(a - b) <= 0.02 * F.abs(b)
    same = F.lower(F.trim(F.col("answered").cast("string"))) == F.lower(F.trim(F.col("expected").cast("string")))
    return both.withColumn("hit", F.coalesce(F.when(a.isNotNull() & b.isNotNull(), close).otherwise(same), F.lit(False)))


def unit_ratio(a: Column, b: Column) -> Column:
    """Whether two factors differ by a step of the unit ladder: a power of ten from 1e-6 to 1e6."""
    power = F.log10(F.abs(a / b))
    return F.coalesce((F.abs(power - F.round(power)) < 0.01) & (F.abs(power) <= 6) & (F.round(power) != 0), F.lit(False))
