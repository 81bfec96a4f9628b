"""A seeded table with planted defects: a leak by presence, duplicates, a constant, an identifier, a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _unit(seed: int, i: int) -> Column:
    """A pseudo-random number in [0, 1) of a row and a place, the same on every run."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "id"), F.lit(1 << 53)) / F.lit(float(1 << 53))


def sample(spark: SparkSession, rows: int = 500, seed: int = 42) -> DataFrame:
    """rows + 3 rows (the last three repeat earlier ones), thirteen columns of strings."""
    u = lambda i: _unit(seed, i)
    normal = lambda i, mean, sd: mean + sd * F.sqrt(-2 * F.log(1 - u(i))) * F.cos(2 * 3.141592653589793 * u(i + 100))
    pick = lambda i, *levels: F.element_at(F.array(*[F.lit(x) for x in levels]), (F.floor(u(i) * len(levels)) + 1).cast("int"))
    churn = u(1) < 0.2
    df = spark.range(rows).select(
        (F.col("id") + 1000).cast("string").alias("employee_id"),
        F.lit("Acme").alias("company"),
        F.date_format(F.date_add(F.lit("2015-01-01").cast("date"), (u(2) * 3000).cast("int")), "yyyy-MM-dd").alias("hire_date"),
        F.round(normal(3, 40, 9)).cast("int").cast("string").alias("age"),
        pick(4, "female", "male", "other").alias("gender"),
        pick(5, "sales", "engineering", "support", "finance", "legal").alias("department"),
        F.round(u(6) * 20).cast("int").cast("string").alias("years_experience"),
        pick(7, "school", "bachelor", "master", "doctor").alias("education"),
        F.when(u(8) < 0.02, "").otherwise(F.round(normal(9, 52_000, 9_000) - F.when(churn, 9_000).otherwise(0)).cast("int").cast("string")).alias("salary"),
        (F.floor(u(10) * 5) + 1).cast("string").alias("performance_score"),
        (u(11) < 0.4).cast("int").cast("string").alias("remote_work"),
        F.when(churn, (F.floor(u(12) * 5) + 1).cast("string")).otherwise("").alias("exit_interview_score"),
        churn.cast("int").cast("string").alias("churn"),
    )
    again = df.where(F.col("employee_id").isin("1003", "1010", "1020"))
    return df.unionByName(again)
