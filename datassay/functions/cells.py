"""The scalar policies every operator rests on: what is missing, what is a number, what is the same value.

Cells are strings. to_cell() turns typed columns into them, so that equal values give equal cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cells that count as missing once trimmed and lower-cased, and the form of a number.
MISSING = ("", "na", "n/a", "nan", "null", "none", "?")
EDGES = r"^[\s ﻿]+|[\s ﻿]+$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# The same two as one pattern each, so that most cells are told by a match that fails early.
BLANKS = "[\\s\u00a0\ufeff]*"
MISSING_CELL = f"(?i)^{BLANKS}(?:" + "|".join(m.replace("?", "\\?") for m in MISSING[1:]) + f")?{BLANKS}\\z"
NUMBER_CELL = f"^{BLANKS}{NUMBER[1:-1]}{BLANKS}\\z"
WHOLE = ("tinyint", "smallint", "int", "bigint")
EXACT = 1 << 53


def to_cell(df: DataFrame, name: str) -> Column:
    """A column as strings; timestamps as ISO, whole doubles without a fraction."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType.simpleString()
    if kind in ("double", "float"):
        return number_text(c.cast("double"))
    if kind.startswith("timestamp"):
        below = F.pmod(F.unix_micros(c.cast("timestamp")), F.lit(1_000_000)) != 0
        return F.when(below, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"))
    return c.cast("string")


def family(df: DataFrame, name: str) -> str:
    """double, bigint, timestamp or string: how a column's values are grouped and hashed."""
    kind = df.schema[name].dataType.simpleString()
    return "double" if kind in ("double", "float") else "bigint" if kind in WHOLE else "timestamp" if kind.startswith("timestamp") else "string"


def native(df: DataFrame, name: str) -> Column:
    """A column in its family's type, equal exactly where its cells are; NaN is null."""
    c, kind = F.col(f"`{name}`"), family(df, name)
    if kind == "double":
        x = c.cast("double")
        return F.when(~F.isnan(x), x + F.lit(0.0))
    return to_cell(df, name) if kind == "string" else c.cast(kind)


def row_key(df: DataFrame, columns: list[str], as_text: set[str] = frozenset()) -> list[Column]:
    """128 bits (k1, k2) that stand for a row's cells, null and empty alike: rows meet by these, so cells are not shuffled.

    as_text: columns to be hashed by their text, where the other table has them in another type.
    """
    parts: list[Column] = []
    for c in columns:
        if c in as_text or family(df, c) == "string":
            parts.append(F.coalesce(to_cell(df, c), F.lit("")))
        else:
            parts += [native(df, c), F.isnull(native(df, c))]  # a hash skips nulls
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(3), *reversed(parts)).alias("k2")]


def typed_key(df: DataFrame, name: str) -> Column:
    """The grouping key of a column, null where it is missing: native values for typed columns, key() for text."""
    c = native(df, name)
    if family(df, name) != "string":
        return c
    word = F.lower(c)
    return F.when(c.rlike(r"^[A-Za-z]+\z"), F.when(~word.isin(*MISSING), word)).when(~is_missing(c), key(c))


def number_text(x: Column) -> Column:
    """An injective text of a double, whole numbers as integers and -0 as 0."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(x.isNull() | F.isnan(x), F.lit(None)).when(whole, F.when(whole, x).cast("bigint").cast("string")).otherwise(x.cast("string"))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def is_missing(c: Column) -> Column:
    return c.isNull() | c.rlike(MISSING_CELL)


def number(c: Column) -> Column:
    """The cell's number, or null: the whole trimmed string is one, and it is finite."""
    x = F.when(c.rlike(NUMBER_CELL), trimmed(c)).try_cast("double")
    return F.when(F.abs(x) < float("inf"), x + F.lit(0.0))


def as_number(df: DataFrame, name: str) -> Column:
    """A column of any type as numbers, null where a cell is none or not finite."""
    if family(df, name) in ("double", "bigint"):
        x = F.col(f"`{name}`").cast("double")
        return F.when(F.abs(x) < float("inf"), x + F.lit(0.0))
    return number(to_cell(df, name))


def key(c: Column) -> Column:
    """What makes two cells the same value: equal numbers, or equal trimmed lower-case text."""
    # The number is bound once: repeated in place, the expression grows to a method that the JVM does not compile.
    rest = F.transform(F.array(number(c)), lambda x: F.when(x.isNotNull(), number_text(x)).otherwise(F.lower(trimmed(c))))[0]
    return F.when(c.rlike(r"^[A-Za-z]+\z"), F.lower(c)).otherwise(rest)


def level_key(df: DataFrame, name: str) -> Column:
    """key() of a column's cells, null where they are missing; typed cells are not parsed for it."""
    cell, kind = to_cell(df, name), family(df, name)
    if kind == "string":
        return F.when(~is_missing(cell), key(cell))
    if kind == "timestamp":
        return F.lower(cell)
    x = F.col(f"`{name}`").cast("double")
    if kind == "bigint":
        return F.when(F.abs(x) < 1e15, cell).otherwise(number_text(x))
    return F.when(F.abs(x) < float("inf"), cell).otherwise(F.lower(cell))


def half_up(x: Column, digits: int) -> Column:
    """Rounding with halves toward plus infinity."""
    p = float(10**digits)
    return F.floor(x * p + 0.5) / p


def significant(x: Column, digits: int) -> Column:
    """x to so many significant digits."""
    e = F.lit(digits) - 1 - F.floor(F.log10(F.abs(x)))
    p = F.pow(F.lit(10.0), e)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * p) / p)


def clip(c: Column, most: int = 60) -> Column:
    """At most so many characters, with a mark where something was cut."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


# The same policies as DuckDB SQL, for oracles.
def sql_trim(c: str) -> str:
    return f"regexp_replace({c}, '^[\\s\\x{{00a0}}\\x{{feff}}]+|[\\s\\x{{00a0}}\\x{{feff}}]+$', '', 'g')"


def sql_missing(c: str) -> str:
    tokens = ", ".join(f"'{m}'" for m in MISSING)
    return f"({c} IS NULL OR lower({sql_trim(c)}) IN ({tokens}))"


def sql_number(c: str) -> str:
    t = sql_trim(c)
    return f"CASE WHEN regexp_matches({t}, '{NUMBER}') AND abs(TRY_CAST({t} AS DOUBLE)) < 'infinity'::DOUBLE THEN TRY_CAST({t} AS DOUBLE) + 0.0 END"


def sql_cell(c: str, kind: str) -> str:
    if kind == "double":
        return f"CASE WHEN {c} IS NULL OR isnan({c}) THEN NULL WHEN {c} = floor({c}) AND abs({c}) < 1e15 THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"
    if kind == "timestamp":
        return f"strftime({c}, '%Y-%m-%dT%H:%M:%S')"
    return f"CAST({c} AS VARCHAR)"


def sql_key(c: str) -> str:
    return f"CASE WHEN ({sql_number(c)}) IS NOT NULL THEN {sql_cell('(' + sql_number(c) + ')', 'double')} ELSE lower({sql_trim(c)}) END"
