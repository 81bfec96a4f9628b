"""Column profiles from one frequency table.

value_counts() is the only shuffle over the data, with partial sums before it: columns of a type are counted together
by their native values, which become text once a distinct value. Missing counts, shares of numbers, distinct counts, levels, roles
and quality all follow from that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cells import EXACT, family, is_missing, key, native, number, number_text, row_key, to_cell, trimmed

# Thresholds of roles and quality.
DISTINCT_CAP = 20_000
NUMERIC_SHARE, MIXED_SHARE = 0.8, 0.8
ENCODED_MAX = 4
TEXT_LENGTH, TEXT_SPACES, TEXT_DISTINCT = 40, 0.5, 50
ID_SHARE, ENTITY_DISTINCT = 0.95, 50
CODE_LEAST, CODE_MOST = 5, 25
ID_NAME = r"(?i)(\b|_)(id|uuid|key|index|ref)(\b|_|$)"
ID_HINT = r"(?i)(\b|_)(id|uuid|key|index|ref|phone|tel|mobile|fax|zip|zipcode|postal|postcode|ssn|account|acct|ticket|isbn|ean|upc|imei|vin|serial|invoice|plate)(\b|_|$)"
ID_WIDTH, ID_MODAL, ID_MEDIAN_WIDTH, ID_UNIQUE = 5, 0.9, 6, 0.99


def cells(df: DataFrame, columns: list[str] | None = None, order: Column | None = None) -> DataFrame:
    """(col, pos, raw, at): a row for each cell, without a shuffle; at is the row's place by `order` (null: not asked)."""
    names = columns or df.columns
    at = (order if order is not None else F.lit(None)).cast("bigint")
    each = F.array(*[F.struct(F.lit(c).alias("col"), F.lit(i).alias("pos"), to_cell(df, c).alias("raw")) for i, c in enumerate(names)])
    return df.select(at.alias("at"), F.explode(each).alias("c")).select("c.col", "c.pos", "c.raw", "at")


def value_counts(df: DataFrame, columns: list[str] | None = None, order: Column | None = None) -> DataFrame:
    """(col, pos, raw, n, first, missing, num, key, exact): how often each cell occurs, and its derived values.

    exact: distinct cells of the column are distinct keys too, so nothing has to be grouped again by key.
    """
    names = columns or df.columns
    out: DataFrame | None = None
    for kind in ("double", "bigint", "timestamp", "string"):
        own = [(i, c) for i, c in enumerate(names) if family(df, c) == kind]
        if not own:
            continue
        each = F.array(*[F.struct(F.lit(i).alias("pos"), native(df, c).alias("v")) for i, c in own])
        place = [] if order is None else [order.cast("bigint").alias("at")]
        rows = df.select(*place, F.explode(each).alias("c")).select("c.pos", "c.v", *(["at"] if place else []))
        first = [] if order is None else [F.min("at").alias("first")]
        counts = rows.groupBy("pos", "v").agg(F.count("*").alias("n"), *first)
        v, none = F.col("v"), F.lit(None)
        if kind == "double":
            raw, num = number_text(v), F.when(F.abs(v) < float("inf"), v)
            derived = (raw, v.isNull(), num, F.when(num.isNotNull(), raw).otherwise(F.lower(raw)), F.lit(True))
        elif kind == "bigint":
            raw, num = v.cast("string"), v.cast("double")
            derived = (raw, v.isNull(), num, F.when(F.abs(num) < 1e15, raw).otherwise(number_text(num)), F.abs(num) <= EXACT)
        elif kind == "timestamp":
            # The values are the column's own, under its name again.
            raw = to_cell(counts, "v")
            derived = (raw, v.isNull(), none.cast("double"), F.lower(raw), F.lit(True))
        else:
            raw, gone = v, is_missing(v)
            derived = (raw, gone, F.when(~gone, number(raw)), F.when(~gone, key(raw)), F.lit(False))
        seen = F.col("first") if first else none.cast("bigint")
        col = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("pos") + 1)
        raw, gone, num, keyed, exact = derived
        part = counts.select(col.alias("col"), "pos", raw.alias("raw"), "n", seen.alias("first"), gone.alias("missing"), num.alias("num"), F.when(~gone, keyed).alias("key"), exact.alias("exact"))
        out = part if out is None else out.unionByName(part)
    return out


def levels(counts: DataFrame) -> DataFrame:
    """(col, pos, key, num, n, first, label): the level table; the label is the first spelling, trimmed."""
    present = counts.where(~F.col("missing"))
    return present.groupBy("col", "pos", "key").agg(F.max("num").alias("num"), F.sum("n").alias("n"), F.min("first").alias("first"), F.min_by(trimmed(F.col("raw")), F.struct("first", "raw")).alias("label"))


def column_profile(counts: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row a column: rows, present, missing, numeric, all_integers, avg_length, space_share, distinct, distinct_raw, min, max."""
    p, n = ~F.col("missing"), F.col("n")
    num = F.when(p, F.col("num"))
    by = counts.groupBy("col", "pos").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(p, n).otherwise(0)).alias("present"),
        F.sum(F.when(F.col("missing"), n).otherwise(0)).alias("missing"),
        F.sum(F.when(num.isNotNull(), n).otherwise(0)).alias("numeric"),
        F.coalesce(F.bool_and(F.when(p, F.coalesce(num == F.floor(num), F.lit(False)))), F.lit(False)).alias("all_integers"),
        F.coalesce(F.sum(F.when(p, F.length("raw") * n)) / F.sum(F.when(p, n)), F.lit(0.0)).alias("avg_length"),
        F.coalesce(F.sum(F.when(p & F.contains("raw", F.lit(" ")), n).otherwise(0)) / F.sum(F.when(p, n)), F.lit(0.0)).alias("space_share"),
        F.count(F.when(p, 1)).alias("distinct_raw"),
        F.count(F.when(p & F.col("exact"), 1)).alias("distinct_exact"),
        F.min(num).alias("min"),
        F.max(num).alias("max"),
    )
    same = counts.where(p & ~F.col("exact")).groupBy("col", "key").agg(F.lit(1).alias("one")).groupBy("col").agg(F.count("*").alias("keys"))
    return by.join(same, "col", "left").withColumn("distinct", F.col("distinct_exact") + F.coalesce("keys", F.lit(0))).drop("keys", "distinct_exact")


def identifier_shapes(counts: DataFrame) -> DataFrame:
    """(col, sequence, leading_zero, integers, constant_width, median_width, uniqueness): what the identifier rules ask of values, over all of them."""
    t, p = trimmed(F.col("raw")), counts.where(~F.col("missing"))
    whole = p.withColumn("width", F.when(t.rlike(r"^-?\d+$"), F.length(F.replace(t, F.lit("-"), F.lit(""))))).withColumn("zero", t.rlike(r"^0\d+$"))
    n, num = F.col("n"), F.col("num")
    numbers = F.sum(F.when(num.isNotNull(), n).otherwise(0))
    step = (F.min(num).isin(0.0, 1.0)) & (F.max(num) - F.min(num) + 1 == numbers) & (F.count_distinct(num) == numbers) & F.bool_and(F.coalesce(num == F.floor(num), F.lit(True)))
    by = whole.groupBy("col").agg(
        F.sum("n").alias("m"),
        F.count("*").alias("d"),
        numbers.alias("numbers"),
        F.coalesce(step, F.lit(False)).alias("step"),
        F.bool_or("zero").alias("leading_zero"),
        F.bool_and(F.col("width").isNotNull()).alias("integers"),
    )
    # A row for each column and width.
    widths = whole.where("width is not null").groupBy("col", "width").agg(F.sum("n").alias("n"))
    upto = widths.withColumn("upto", F.sum("n").over(Window.partitionBy("col").orderBy("width"))).withColumn("total", F.sum("n").over(Window.partitionBy("col")))
    wide = upto.groupBy("col").agg(
        F.max_by("width", F.struct("n", -F.col("width"))).alias("modal"), (F.max("n") / F.max("total")).alias("share"), F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("width"))).alias("median_width")
    )
    unique = F.col("d") / F.col("m")
    return by.join(wide, "col", "left").select(
        "col",
        (F.col("step") & (F.col("m") > 10) & (unique > ID_SHARE) & (F.col("numbers") / F.col("m") > ID_SHARE)).alias("sequence"),
        "leading_zero",
        "integers",
        F.coalesce((F.col("modal") >= ID_WIDTH) & (F.col("share") >= ID_MODAL), F.lit(False)).alias("constant_width"),
        F.coalesce("median_width", F.lit(0)).alias("median_width"),
        unique.alias("uniqueness"),
    )


def identifiers(profile: DataFrame, shapes: DataFrame) -> DataFrame:
    """(col, identifier): by name and uniqueness, a sequence from 0 or 1, leading zeros, or a name's hint with a shape that fits it."""
    hint, near = F.col("col").rlike(ID_HINT), F.col("uniqueness") > ID_UNIQUE
    named = F.col("col").rlike(ID_NAME) & (F.col("distinct_raw") / F.col("rows") > 0.9)
    wide = near & F.col("integers") & (F.col("median_width") >= ID_MEDIAN_WIDTH) & (hint | F.col("constant_width"))
    rule = F.col("sequence") | F.col("leading_zero") | (hint & (F.col("constant_width") | near)) | wide
    return profile.select("col", "distinct_raw", "rows").join(shapes, "col", "left").select("col", (named | F.coalesce(rule, F.lit(False))).alias("identifier"))


def roles(profile: DataFrame, temporal: DataFrame | None = None, found: DataFrame | None = None, target: str | None = None) -> DataFrame:
    """profile with role: the ordered cascade over the profile; temporal: (col, temporal); found: (col, identifier), where values are asked too."""
    named = F.col("col").rlike(ID_NAME)
    is_target = F.col("col") == F.lit(target) if target else F.lit(False)
    df = profile.join(temporal, "col", "left") if temporal is not None else profile.withColumn("temporal", F.lit(False))
    df = df.join(found, "col", "left") if found is not None else df.withColumn("identifier", F.lit(False))
    identifier = F.coalesce("identifier", F.lit(False)) | (named & (F.col("distinct_raw") / F.col("rows") > 0.9))
    capped = F.col("distinct") > DISTINCT_CAP
    present = F.col("present")
    role = (
        F.when(identifier & ~is_target, "identifier")
        .when(present == 0, "categorical")
        .when(F.coalesce("temporal", F.lit(False)), "temporal")
        .when(F.col("distinct") == 2, "binary")
        .when(named & ~is_target & (F.col("distinct") > ENTITY_DISTINCT), "identifier")
        .when(named & ~is_target, "categorical")
        .when((F.col("numeric") / present >= NUMERIC_SHARE) & F.col("all_integers") & (F.col("distinct") <= ENCODED_MAX), "categorical")
        .when(F.col("numeric") / present >= NUMERIC_SHARE, "numeric")
        .when((F.col("avg_length") >= TEXT_LENGTH) & (F.col("space_share") >= TEXT_SPACES) & (F.col("distinct") > TEXT_DISTINCT), "text")
        .when(~is_target & ~capped & (present > 10) & (F.col("distinct") / present > ID_SHARE), "identifier")
        .otherwise("categorical")
    )
    return df.withColumn("role", role)


def quality_flags(profile: DataFrame) -> DataFrame:
    """(col, constant, high_cardinality, mixed_numeric, possible_code) from a profile with roles."""
    p = F.col("present")
    code = F.col("distinct_raw").between(CODE_LEAST, CODE_MOST) & F.col("all_integers") & F.col("min").isin(0, 1) & (F.col("distinct") == F.col("max") - F.col("min") + 1)
    return profile.select(
        "col",
        (F.col("distinct_raw") == 1).alias("constant"),
        (~F.col("role").isin("identifier", "temporal", "text", "numeric") & (p > 10) & (F.col("distinct_raw") / p > ID_SHARE)).alias("high_cardinality"),
        ((F.col("numeric") < p) & (F.col("numeric") / p > MIXED_SHARE)).alias("mixed_numeric"),
        F.coalesce(code, F.lit(False)).alias("possible_code"),
    )


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """rows, distinct_rows, duplicates: exact copies, null and empty alike. Rows meet by 128 bits of hash, not by their text."""
    keys = df.select(*row_key(df, columns or df.columns)).groupBy("k1", "k2").agg(F.count("*").alias("n"))
    return keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def quality_score(profile: DataFrame, duplicates: DataFrame) -> DataFrame:
    """score and its parts: 100 less the rounded weighted losses for missing cells, duplicates, constants and identifiers, at least 0."""
    share = F.col("missing") / F.col("rows") * 100
    one = profile.agg(
        (F.sum("missing") / F.sum("rows") * 100).alias("missing_pct"),
        F.max(share).alias("worst"),
        F.count(F.when(share > 20, 1)).alias("gappy"),
        F.count(F.when(F.col("distinct_raw") == 1, 1)).alias("constants"),
        F.count(F.when(F.col("role") == "identifier", 1)).alias("ids"),
    ).crossJoin(F.broadcast(duplicates))  # one row by one row
    up = lambda c: F.floor(c + 0.5)
    worst = F.when(F.col("worst") > 20, up((F.col("worst") - 20) / 80 * 30)).otherwise(0)
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0))
    missing = clip(100 - 2 * F.col("missing_pct") - worst - 5 * F.col("gappy"))
    dups = clip(100 - F.coalesce(F.try_divide(F.col("duplicates"), F.col("distinct_rows") + F.col("duplicates")), F.lit(0.0)) * 100 * 50)
    constant, ids = clip(100.0 - 15 * F.col("constants")), clip(100.0 - 3 * F.col("ids"))
    loss = up(0.45 * (100 - missing)) + up(0.25 * (100 - dups)) + up(0.15 * (100 - constant)) + up(0.15 * (100 - ids))
    return one.select("missing_pct", "duplicates", "constants", "ids", F.greatest(F.lit(0.0), 100.0 - loss).cast("int").alias("score"))


def class_balance(counts: DataFrame, target: str) -> DataFrame:
    """(label, n, pct, imbalanced): classes of the target over all rows, missing ones a class of their own."""
    own = counts.where(F.col("col") == target)
    rows = own.groupBy(F.coalesce("key", F.lit("(missing)")).alias("label")).agg(F.sum("n").alias("n"))
    total = Window.partitionBy()
    pct = F.floor(F.col("n") / F.sum("n").over(total) * 1000 + 0.5) / 10
    out = rows.withColumn("pct", pct)
    ratio = F.coalesce(F.try_divide(F.max("pct").over(total), F.min("pct").over(total)), F.lit(float("inf")))
    return out.withColumn("imbalanced", (ratio > 3) | (F.max("pct").over(total) > 80))


def top_levels(counts: DataFrame, k: int = 10) -> DataFrame:
    """(col, key, n, pct, rank): the k most frequent levels of each column, ties by key."""
    w = Window.partitionBy("col")
    table = levels(counts)
    total = table.groupBy("col").agg(F.sum("n").alias("present"))
    ranked = table.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "key"))).where(F.col("rank") <= k)
    return ranked.join(total, "col").select("col", "key", "n", (F.col("n") / F.col("present")).alias("share"), "rank")
