"""Grouped findings: conflicting labels, id-only repeats, targets that a repeated value gives away, formulas between columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import as_number, family, is_missing, key, level_key, native, row_key, significant, to_cell, typed_key


def label_conflicts(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """One row: groups and rows of equal features with two targets or more, groups in all, and their share of the rows."""
    rows = df.select(*row_key(df, features), level_key(df, target).alias("t")).where("t is not null")
    by = rows.groupBy("k1", "k2", "t").agg(F.count("*").alias("n")).groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.count("*").alias("targets"))
    return by.agg(F.count(F.when(F.col("targets") > 1, 1)).alias("conflict_groups"), F.coalesce(F.sum(F.when(F.col("targets") > 1, F.col("n"))), F.lit(0)).alias("conflict_rows"), F.count("*").alias("groups"), F.coalesce(F.floor(F.try_divide(F.count("*"), F.sum("n")) * 1000 + 0.5) / 1000, F.lit(0.0)).alias("distinct_share"))


def conflict_examples(df: DataFrame, features: list[str], target: str, order: Column, groups: int = 3, lines: int = 5) -> DataFrame:
    """(first, rows, lines, targets) of the first conflicting groups: line numbers count the header, so a row's is its place + 2."""
    cell = to_cell(df, target)
    rows = df.where(~is_missing(cell)).select(*row_key(df, features), key(cell).alias("t"), order.cast("bigint").alias("at"))
    by = rows.groupBy("k1", "k2").agg(F.count("*").alias("rows"), F.min("at").alias("first"), F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo <> hi").orderBy("first").limit(groups)
    held = rows.join(F.broadcast(by.select("k1", "k2", "first", "rows")), ["k1", "k2"])
    # So many groups, each cut to its first lines before they meet.
    from pyspark.sql.window import Window

    cut = held.withColumn("i", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("at"))).where(F.col("i") <= lines)
    return cut.groupBy("first", "rows").agg(F.sort_array(F.collect_list(F.col("at") + 2)).alias("lines"), F.sort_array(F.collect_set("t")).alias("targets"))


def id_only_repeats(df: DataFrame, features: list[str], ids: list[str], target: str) -> DataFrame:
    """One row: rows that repeat another's features and target and differ in their ids only."""
    if not ids:
        return df.sparkSession.createDataFrame([(0,)], "repeats bigint")
    cell = to_cell(df, target)
    i1, i2 = (c.alias(n) for c, n in zip(row_key(df, ids), ("i1", "i2")))
    rows = df.where(~is_missing(cell)).select(*row_key(df, features), key(cell).alias("t"), i1, i2).distinct()
    return rows.groupBy("k1", "k2", "t").agg((F.count("*") - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("repeats"))


def same_target_values(df: DataFrame, columns: list[str], target: str, least_distinct: int = 50, least_rows: int = 20) -> DataFrame:
    """(col, repeated_rows, same, base, gain): of rows that share their column's value with another, how often they also share the target, against the largest class's share."""
    cells: DataFrame | None = None
    for kind in ("double", "bigint", "timestamp", "string"):
        own = [c for c in columns if family(df, c) == kind]
        if own:
            # Native values are counted first, so text is looked at once for each value and target.
            each = F.array(*[F.struct(F.lit(c).alias("col"), native(df, c).alias("v")) for c in own])
            rows = df.select(typed_key(df, target).alias("t"), F.explode(each).alias("e")).where("t is not null and e.v is not null").groupBy("e.col", "e.v", "t").agg(F.count("*").alias("n"))
            if kind == "string":
                rows = rows.where(~is_missing(F.col("v"))).groupBy("col", key(F.col("v")).alias("v"), "t").agg(F.sum("n").alias("n"))
            part = rows.select("col", F.xxhash64("v").alias("k"), F.xxhash64(F.lit(1), "v").alias("k2"), "t", "n")
            cells = part if cells is None else cells.unionByName(part)
    value = cells.groupBy("col", "k", "k2").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    base = cells.groupBy("col", "t").agg(F.sum("n").alias("n")).groupBy("col").agg((F.max("n") / F.sum("n")).alias("base"))
    by = value.groupBy("col").agg(F.count("*").alias("distinct"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated_rows"), F.sum(F.when(F.col("n") > 1, F.col("top")).otherwise(0)).alias("agree"))
    out = by.join(base, "col").where((F.col("distinct") > least_distinct) & (F.col("repeated_rows") >= least_rows) & (F.col("base") < 1))
    same = F.col("agree") / F.col("repeated_rows")
    return out.select("col", "repeated_rows", same.alias("same"), "base", significant((same - F.col("base")) / (1 - F.col("base")), 4).alias("gain"))


def formula_check(df: DataFrame, result: str, op: str, terms: list[str], offsets: int = 5) -> DataFrame:
    """(rows, matches, share): how often result equals op(terms) within the larger of 0.01 and 1 %."""
    x = [as_number(df, c) for c in terms]
    value = {"sum": lambda: sum(x[1:], x[0]), "difference": lambda: sum((-v for v in x[1:]), x[0]), "product": lambda: _product(x), "ratio": lambda: F.try_divide(x[0], x[1])}[op]()
    rows = df.select(as_number(df, result).alias("r"), value.alias("v")).where("r is not null and v is not null")
    match = F.abs(F.col("r") - F.col("v")) <= F.greatest(F.lit(0.01), F.abs(F.col("r")) * 0.01)
    return rows.agg(F.count("*").alias("rows"), F.count(F.when(match, 1)).alias("matches")).withColumn("share", F.coalesce(F.try_divide(F.col("matches"), F.col("rows")), F.lit(0.0)))


def formula_offsets(df: DataFrame, result: str, terms: list[str], k: int = 5) -> DataFrame:
    """(offset, n): the k most frequent fixed differences, to the cent, between result and the sum of terms."""
    x = [as_number(df, c) for c in terms]
    diff = F.floor((as_number(df, result) - sum(x[1:], x[0])) * 100 + 0.5) / 100
    return df.select(diff.alias("offset")).where("offset is not null").groupBy("offset").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "offset").limit(k)


def _product(x: list[Column]) -> Column:
    out = x[0]
    for v in x[1:]:
        out = out * v
    return out


def group_purity(df: DataFrame, group: str, target: str) -> DataFrame:
    """(rows, repeated_rows, purity, base): a class target's purity within repeated values of group."""
    cells = df.select(typed_key(df, group).alias("g"), typed_key(df, target).alias("t")).where("g is not null and t is not null").groupBy("g", "t").agg(F.count("*").alias("n"))
    by = cells.groupBy("g").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    base = cells.groupBy("t").agg(F.sum("n").alias("n")).agg((F.max("n") / F.sum("n")).alias("base"))
    rep = F.col("n") > 1
    one = by.agg(F.sum("n").alias("rows"), F.sum(F.when(rep, F.col("n")).otherwise(0)).alias("repeated_rows"), F.sum(F.when(rep, F.col("top")).otherwise(0)).alias("agree"))
    return one.crossJoin(F.broadcast(base)).select("rows", "repeated_rows", F.coalesce(F.try_divide(F.col("agree"), F.col("repeated_rows")), F.lit(0.0)).alias("purity"), "base")


def balanced_accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    by = df.groupBy(F.col(truth).alias("y")).agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("hit"))
    return by.agg(F.avg("hit").alias("balanced_accuracy"))


def kappa(df: DataFrame, one: str, other: str) -> DataFrame:
    """(n, agree, expected, kappa) of two labellings."""
    cells = df.where(F.col(one).isNotNull() & F.col(other).isNotNull()).groupBy(F.col(one).alias("x"), F.col(other).alias("y")).agg(F.count("*").alias("o"))
    rows, cols = cells.groupBy("x").agg(F.sum("o").alias("rx")), cells.groupBy("y").agg(F.sum("o").alias("cy"))
    total = cells.agg(F.sum("o").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("o")).otherwise(0)).alias("d"))
    chance = rows.join(cols, F.col("x") == F.col("y")).agg(F.coalesce(F.sum(F.col("rx") * F.col("cy")), F.lit(0)).alias("e"))
    n = F.col("n").cast("double")
    po, pe = F.col("d") / n, F.col("e") / (n * n)
    return total.crossJoin(F.broadcast(chance)).select("n", po.alias("agree"), pe.alias("expected"), F.when(pe < 1, (po - pe) / F.nullif(1 - pe, F.lit(0.0))).otherwise(F.lit(1.0)).alias("kappa"))
