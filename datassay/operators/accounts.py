"""Usage, sessions and budgets as queries over tables: counts by period, conditional claims as set operations, sessions that still hold."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# How long a reservation without an answer counts, and the form of an analysis id.
PENDING = datetime.timedelta(minutes=10)
ANALYSIS_ID = "^[A-Za-z0-9_-]{8,64}$"


def period_key(ts: Column) -> Column:
    """The UTC day of a time."""
    return F.date_format(ts, "yyyy-MM-dd")


def resets_on(ts: Column) -> Column:
    """The day after a time's."""
    return F.date_format(F.date_add(F.to_date(ts), 1), "yyyy-MM-dd")


def month_start(ts: Column) -> Column:
    return F.date_trunc("month", ts)


def valid_id(c: Column) -> Column:
    return F.coalesce(c.rlike(ANALYSIS_ID), F.lit(False))


def token_hash(c: Column) -> Column:
    """What is stored of a session's token."""
    return F.sha2(c, 256)


def live(now: datetime.datetime) -> Column:
    """An analysis counts when it was answered, or is a reservation still in flight."""
    return (F.col("requests") > 0) | (F.col("created_at") > F.lit(now - PENDING).cast("timestamp"))


def usage(analyses: DataFrame, now: datetime.datetime, limit: int) -> DataFrame:
    """(user_id, period, used, free, resets): analyses (user_id, created_at, requests) that count, by user and day."""
    day = period_key(F.col("created_at"))
    by = analyses.where(live(now)).groupBy("user_id", day.alias("period")).agg(F.count("*").alias("used"), F.max("created_at").alias("last"))
    return by.select("user_id", "period", "used", F.greatest(F.lit(limit) - F.col("used"), F.lit(0)).alias("free"), resets_on(F.col("last")).alias("resets"))


def claims(analyses: DataFrame, asked: DataFrame, now: datetime.datetime, limit: int) -> DataFrame:
    """asked (user_id, id, created_at) with granted: a known id is granted again, new ones in order of time while the user's day has room.

    One statement over a batch of requests: the first to come are granted, whatever the order of rows; the caller appends the granted new ones.
    """
    day = period_key(F.col("created_at"))
    used = analyses.where(live(now)).groupBy("user_id", day.alias("period")).agg(F.count("*").alias("used"))
    known = analyses.select("user_id", "id").distinct().withColumn("known", F.lit(True))
    rows = asked.withColumn("period", day).join(used, ["user_id", "period"], "left").join(known, ["user_id", "id"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    first = F.row_number().over(Window.partitionBy("user_id", "period", "id").orderBy("created_at")) == 1
    rows = rows.withColumn("new", (~F.col("known") & first).cast("int"))
    turn = F.sum("new").over(Window.partitionBy("user_id", "period").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("fits", turn + F.coalesce("used", F.lit(0)) <= limit)
    # A repeat of an id asked for in the same batch goes as its first does.
    same = F.max(F.when(F.col("new") == 1, F.col("fits"))).over(Window.partitionBy("user_id", "period", "id"))
    granted = valid_id(F.col("id")) & (F.col("known") | F.coalesce(same, F.lit(False)))
    return rows.select("user_id", "id", "created_at", granted.alias("granted"), (granted & (F.col("new") == 1)).alias("created"))


def released(analyses: DataFrame, failed: DataFrame) -> DataFrame:
    """analyses without the reservations (user_id, id) whose answer failed and that were never answered."""
    return analyses.join(failed.select("user_id", "id").distinct().withColumn("failed", F.lit(True)), ["user_id", "id"], "left").where(~(F.coalesce("failed", F.lit(False)) & (F.col("requests") == 0))).drop("failed")


def upserted(table: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """table with rows put in: of each key the newest by `order`, the new one on a tie."""
    both = table.withColumn("datassay_new", F.lit(0)).unionByName(rows.withColumn("datassay_new", F.lit(1)))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("datassay_new")))
    return both.withColumn("datassay_i", best).where("datassay_i = 1").drop("datassay_i", "datassay_new")


def budget(spent: DataFrame, caps: DataFrame) -> DataFrame:
    """(day, provider, used, available): spent (day, provider, amount) against caps (provider, cap)."""
    by = spent.groupBy("day", "provider").agg(F.sum("amount").alias("used"))
    return by.join(F.broadcast(caps), "provider").select("day", "provider", "used", (F.col("used") < F.col("cap")).alias("available"))  # a row a provider


def sessions(tokens: DataFrame, users: DataFrame, now: datetime.datetime) -> DataFrame:
    """(user_id, and what users holds) of sessions (token_hash, user_id, expires_at) that have not expired."""
    return tokens.where(F.col("expires_at") > F.lit(now).cast("timestamp")).select("token_hash", "user_id").join(users, "user_id")


def history(analyses: DataFrame, user: str, limit: int) -> DataFrame:
    """A user's analyses, newest first."""
    return analyses.where(F.col("user_id") == user).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def payload_shape(payload: Column) -> Column:
    """(rows, columns) that a JSON payload states, for the history: rows, and the number of its columns."""
    return F.struct(F.get_json_object(payload, "$.rows").try_cast("bigint").alias("rows"), F.size(F.from_json(F.get_json_object(payload, "$.columns"), "array<string>")).alias("columns"))
