"""Dates in string cells: families, columns of dates, orientation, parsing to UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import trimmed

# The families of date texts, and the months' names.
ISO_DATE = r"^(\d{4})-(\d{2})-(\d{2})$"
ISO_DATETIME = r"^(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2})(?::(\d{2}))?(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?$"
SLASH_YMD = r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})$"
SLASH_DM = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})$"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTH_ALT = "|".join(m if len(m) == 3 else f"{m[:3]}(?:{m[3:]})?" for m in MONTHS)
MONTH_DAY_FIRST = rf"(?i)^({MONTH_ALT})\s+(\d{{1,2}}),?\s+(\d{{2,4}})$"
DAY_MONTH_FIRST = rf"(?i)^(\d{{1,2}})[\s-]+({MONTH_ALT})[\s-]+(\d{{2,4}})$"
# A text that can be a date at all: most cells are told by this one short match.
MAYBE = r"(?i)^(?:\d{1,4}[-/. ]|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"


def _part(c: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(c, pattern, i).try_cast("int")


def family(c: Column) -> Column:
    """iso, slash_ymd, month, slash_dm or null; months within 1 to 12, days within 1 to 31, hours and minutes in range."""
    t = trimmed(c)
    ymd = lambda p: _part(t, p, 2).between(1, 12) & _part(t, p, 3).between(1, 31)
    clock = (_part(t, ISO_DATETIME, 4) <= 23) & (_part(t, ISO_DATETIME, 5) <= 59) & (F.coalesce(_part(t, ISO_DATETIME, 6), F.lit(0)) <= 59)
    a, b = _part(t, SLASH_DM, 1), _part(t, SLASH_DM, 2)
    either = (a.between(1, 12) & b.between(1, 31)) | (b.between(1, 12) & a.between(1, 31))
    day = F.coalesce(_part(t, MONTH_DAY_FIRST, 2), _part(t, DAY_MONTH_FIRST, 1))
    iso = F.when(t.rlike(ISO_DATE), ymd(ISO_DATE)).when(t.rlike(ISO_DATETIME), ymd(ISO_DATETIME) & clock)
    found = F.when(iso, "iso").when(t.rlike(SLASH_YMD) & ymd(SLASH_YMD), "slash_ymd").when((t.rlike(MONTH_DAY_FIRST) | t.rlike(DAY_MONTH_FIRST)) & day.between(1, 31), "month").when(t.rlike(SLASH_DM) & either, "slash_dm")
    return F.when(t.rlike(MAYBE), found)


def family_counts(counts: DataFrame) -> DataFrame:
    """(col, family, n) of the present cells; family is null for what is no date."""
    return counts.where(~F.col("missing")).groupBy("col", F.when(F.col("num").isNull(), family(F.col("raw"))).alias("family")).agg(F.sum("n").alias("n"))


def temporal_columns(counts: DataFrame, sample: int | None = None) -> DataFrame:
    """(col, temporal): 0.9 of the present cells are dates, 0.9 of those of one family, and slashes don't contradict; over all cells, or those among the first `sample` rows."""
    rows = counts.where(~F.col("missing"))
    if sample is not None:
        rows = rows.where(F.col("first") < sample)
    t = trimmed(F.col("raw"))
    kind = F.when(F.col("num").isNull(), family(F.col("raw")))  # no number is a date
    # Only slash dates are asked for their parts, so what can't be one is not parsed for them.
    maybe = F.col("num").isNull() & t.rlike(SLASH_DM)
    rows = rows.select("col", "n", kind.alias("family"), *[F.when(maybe, _part(t, SLASH_DM, i) > 12).alias(f"p{i}") for i in (1, 2)])
    by = rows.groupBy("col", "family").agg(F.sum("n").alias("n"), F.bool_or("p1").alias("p1"), F.bool_or("p2").alias("p2"))
    dates = F.sum(F.when(F.col("family").isNotNull(), F.col("n")).otherwise(0))
    one = by.groupBy("col").agg(F.sum("n").alias("present"), dates.alias("dates"), F.max(F.when(F.col("family").isNotNull(), F.col("n"))).alias("top"), F.coalesce(F.bool_or(F.when(F.col("family") == "slash_dm", F.col("p1"))) & F.bool_or(F.when(F.col("family") == "slash_dm", F.col("p2"))), F.lit(False)).alias("conflict"))
    ok = (F.col("dates") / F.col("present") >= 0.9) & (F.col("top") / F.col("present") >= 0.9) & ~F.col("conflict")
    return one.select("col", F.coalesce(F.when(F.col("dates") > 0, ok), F.lit(False)).alias("temporal"))


def day_first(counts: DataFrame) -> DataFrame:
    """(col, day_first, assumed) for slash dates: day first if some first part is above 12 and no second one is."""
    t = trimmed(F.col("raw"))
    rows = counts.where(~F.col("missing") & t.rlike(SLASH_DM)).select("col", _part(t, SLASH_DM, 1).alias("a"), _part(t, SLASH_DM, 2).alias("b"))
    by = rows.groupBy("col").agg(F.bool_or(F.col("a") > 12).alias("p1"), F.bool_or(F.col("b") > 12).alias("p2"))
    return by.select("col", (F.col("p1") & ~F.col("p2")).alias("day_first"), (~F.col("p1") & ~F.col("p2")).alias("assumed"))


def parse_date(c: Column, day_first: bool = False) -> Column:
    """UTC timestamp, or null for no date or no such day; years of two digits from 50 on are of the 1900s; offsets apply."""
    t = trimmed(c)
    at = lambda y, m, d, *hms: F.try_make_timestamp(y, m, d, *(hms or (F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"))))
    zero = lambda i: F.coalesce(_part(t, ISO_DATETIME, i), F.lit(0))
    zone = F.regexp_replace(F.regexp_extract(F.substring(t, 11, 40), r"([+-]\d{2}:?\d{2})$", 1), ":", "")
    minutes = F.when(zone != "", (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")) * F.when(zone.startswith("-"), -1).otherwise(1)).otherwise(0)
    iso = at(_part(t, ISO_DATETIME, 1), _part(t, ISO_DATETIME, 2), _part(t, ISO_DATETIME, 3), zero(4), zero(5), zero(6).cast("decimal(8,6)"))
    iso = F.timestamp_micros(F.unix_micros(iso) - minutes.cast("bigint") * 60_000_000)

    def year(p: str) -> Column:
        y = _part(t, p, 3)
        return F.when(F.length(F.regexp_extract(t, p, 3)) > 2, y).when(y < 50, y + 2000).otherwise(y + 1900)

    def month(p: str, i: int) -> Column:
        return F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.lower(F.left(F.regexp_extract(t, p, i), F.lit(3)))).cast("int")

    a, b = _part(t, SLASH_DM, 1), _part(t, SLASH_DM, 2)
    slash = at(year(SLASH_DM), b, a) if day_first else at(year(SLASH_DM), a, b)
    return (
        F.when(t.rlike(ISO_DATETIME), iso)
        .when(t.rlike(ISO_DATE), at(_part(t, ISO_DATE, 1), _part(t, ISO_DATE, 2), _part(t, ISO_DATE, 3)))
        .when(t.rlike(SLASH_YMD), at(_part(t, SLASH_YMD, 1), _part(t, SLASH_YMD, 2), _part(t, SLASH_YMD, 3)))
        .when(t.rlike(MONTH_DAY_FIRST), at(year(MONTH_DAY_FIRST), month(MONTH_DAY_FIRST, 1), _part(t, MONTH_DAY_FIRST, 2)))
        .when(t.rlike(DAY_MONTH_FIRST), at(year(DAY_MONTH_FIRST), month(DAY_MONTH_FIRST, 2), _part(t, DAY_MONTH_FIRST, 1)))
        .when(t.rlike(SLASH_DM), slash)
    )
