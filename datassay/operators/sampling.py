"""Deterministic choices of rows: scattered indices, strata in turn, even strides, first rows, spread examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.order import ordinals

# Fixed value: a prime beyond any row count that is sampled this way.
STEP = 2654435761


def sample_indices(df: DataFrame, index: Column, rows: int, limit: int = 20_000) -> DataFrame:
    """Rows whose 0-based index is i * STEP mod rows for some i below limit; all rows where there are no more than that."""
    if rows <= limit:
        return df
    wanted = df.sparkSession.range(limit).select(F.pmod(F.col("id") * F.lit(STEP), F.lit(rows)).alias("datassay_i"))
    return df.withColumn("datassay_i", index.cast("bigint")).join(F.broadcast(wanted.distinct()), "datassay_i", "left_semi").drop("datassay_i")


def shuffled(df: DataFrame, columns: list[str], seed: int = 42) -> Column:
    """A seeded pseudo-random order of rows that depends on their values only."""
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in columns])


def stratified_sample(df: DataFrame, stratum: str, quota: int, group: str | None = None, cap: int | None = None, seed: int = 42) -> DataFrame:
    """quota rows, strata taking turns in pseudo-random order within each; with group and cap, at most cap rows of a group."""
    order = shuffled(df, df.columns, seed)
    out = df.withColumn("datassay_o", order)
    if group and cap:
        out = out.withColumn("datassay_g", F.row_number().over(Window.partitionBy(group).orderBy("datassay_o"))).where(F.col("datassay_g") <= cap).drop("datassay_g")
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy("datassay_o"))
    return out.withColumn("datassay_turn", turn).orderBy("datassay_turn", stratum, "datassay_o").limit(quota).drop("datassay_o", "datassay_turn")


def even_sample(df: DataFrame, value: Column, tie: Column, size: int = 200) -> DataFrame:
    """Every floor(n / size)-th row in the order of value, `size` at most."""
    placed = ordinals(df, value, tie)
    step = F.greatest(F.lit(1), F.floor(F.col("rows") / size))
    return placed.where((F.pmod(F.col("rn") - 1, step) == 0) & (F.col("rn") - 1 < step * size)).drop("rn", "rows")


def snapshot(df: DataFrame, order: Column, rows: int = 10) -> DataFrame:
    """The first rows, empty text as null."""
    return df.orderBy(order).limit(rows).select(*[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def first_seen(df: DataFrame, key: str, order: Column) -> DataFrame:
    """(key, rows, first): groups in the order in which they first occur."""
    by = df.withColumn("datassay_o", order).groupBy(key).agg(F.count("*").alias("rows"), F.min("datassay_o").alias("first"))
    return by.orderBy("first", key)


def interleaved(parts: list[DataFrame], rank: str) -> DataFrame:
    """Ranked answers of several parts as one: all firsts, then all seconds, parts in order."""
    out: DataFrame | None = None
    for i, p in enumerate(parts):
        one = p.withColumn("part", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out.orderBy(rank, "part")
