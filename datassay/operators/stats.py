"""Exact univariate statistics from the frequency table of profile.value_counts().

Moments are weighted sums over distinct values; order statistics of all columns come from one bracketing selection. Both see
each distinct value once, however often it occurs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import select_places, sizes
from .medcouple import medcouples as medcouple_of_all

MEDCOUPLE_SAMPLE = 1500


def numbers(counts: DataFrame) -> DataFrame:
    """(col, num, n): distinct numbers and how often they occur."""
    return counts.where(F.col("num").isNotNull()).groupBy("col", "num").agg(F.sum("n").alias("n"))


def moments(nums: DataFrame) -> DataFrame:
    """(col, n, mean, std, skew, kurtosis, min, max): std with n - 1, skewness and excess kurtosis bias-corrected; 0 where undefined."""
    n = F.col("n")
    first = nums.groupBy("col").agg(F.sum("n").alias("total"), (F.sum(F.col("num") * n) / F.sum("n")).alias("mean"), F.min("num").alias("min"), F.max("num").alias("max"))
    d = F.col("num") - F.col("mean")
    # A row a column: the means go to all tasks.
    second = nums.join(F.broadcast(first), "col").groupBy("col").agg(*[F.sum(F.pow(d, k) * n).alias(f"m{k}") for k in (2, 3, 4)])
    t = F.col("total").cast("double")
    var = F.col("m2") / t
    g1, g2 = F.try_divide(F.col("m3") / t, F.pow(var, 1.5)), F.try_divide(F.col("m4") / t, var * var) - 3
    return first.join(second, "col").select(
        "col",
        F.col("total").alias("n"),
        "mean",
        F.when(t < 2, F.lit(0.0)).otherwise(F.sqrt(F.try_divide(F.col("m2"), t - 1))).alias("std"),
        F.when((t < 3) | (F.col("m2") == 0), F.lit(0.0)).otherwise(g1 * F.sqrt(t * (t - 1)) / F.try_divide(t - 2, F.lit(1.0))).alias("skew"),
        F.when((t < 4) | (F.col("m2") == 0), F.lit(0.0)).otherwise(F.try_divide(((t + 1) * g2 + 6) * (t - 1), (t - 2) * (t - 3))).alias("kurtosis"),
        "min",
        "max",
    )


def cached(nums: DataFrame):
    """nums, cached for the passes of a selection unless it is cached already, and what takes it out again."""
    if nums.is_cached:
        return nums, lambda: None
    own = nums.persist()
    return own, own.unpersist


def order_statistics(nums: DataFrame, places: DataFrame) -> DataFrame:
    """(col, name, value): the value at 0-based place `at` of each column's sorted values; places: (col, name, at), few rows. Computed when called."""
    ask: dict[str, dict[str, int]] = {}
    for r in places.collect():
        ask.setdefault(r["col"], {})[r["name"]] = r["at"]
    own, done = cached(nums)
    found = select_places(own, ask)
    done()
    return nums.sparkSession.createDataFrame([(c, k, v) for c, p in found.items() for k, v in p.items()], "col string, name string, value double")


def quantile_places(probs: dict[str, float], total: int) -> dict[str, int]:
    """The two places about each quantile."""
    h = {k: p * (total - 1) for k, p in probs.items()}
    return {f"{k}<": math.floor(x) for k, x in h.items()} | {f"{k}>": math.ceil(x) for k, x in h.items()}


def interpolated(probs: dict[str, float], total: int, found: dict[str, float]) -> dict[str, float]:
    out = {}
    for k, p in probs.items():
        h = p * (total - 1)
        low, high = found[f"{k}<"], found[f"{k}>"]
        out[k] = low + (high - low) * (h - math.floor(h))
    return out


def quantiles(nums: DataFrame, probs: dict[str, float]) -> DataFrame:
    """(col, <name>...): exact quantiles with linear interpolation between order statistics (type 7). Computed when called."""
    own, done = cached(nums)
    known = sizes(own)
    found = select_places(own, {c: quantile_places(probs, m) for c, (_, m) in known.items()}, known)
    done()
    rows = [(c, *interpolated(probs, known[c][1], p).values()) for c, p in found.items()]
    return nums.sparkSession.createDataFrame(rows, ", ".join(["col string", *(f"`{k}` double" for k in probs)]))


def spaced_places(total: int, most: int | None = None) -> dict[str, int]:
    """The places of at most MEDCOUPLE_SAMPLE evenly spaced order statistics, named in their order."""
    most = most or MEDCOUPLE_SAMPLE
    if total <= most:
        return {f"{i:05d}": i for i in range(total)}
    return {f"{i:05d}": math.floor(i * (total - 1) / (most - 1) + 0.5) for i in range(most)}


def medcouple(nums: DataFrame) -> DataFrame:
    """(col, mc): the medcouple of each column, over MEDCOUPLE_SAMPLE evenly spaced order statistics where there are more values. Computed when called, but for the kernel."""
    own, done = cached(nums)
    known = sizes(own)
    found = select_places(own, {c: spaced_places(m) for c, (_, m) in known.items()}, known)
    done()
    return medcouples(nums, {c: [p[k] for k in sorted(p)] for c, p in found.items()})


def medcouples(nums: DataFrame, samples: dict[str, list[float]]) -> DataFrame:
    """(col, mc) of sorted samples, in tasks."""

    def kernel(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                z = np.array(x) - np.median(x)
                low, high = z[z <= 0], z[z >= 0]
                ties = int((z == 0).sum())
                top = high[:, None] - low[None]
                with np.errstate(divide="ignore", invalid="ignore"):
                    h = (high[:, None] + low[None]) / top
                i, j = np.nonzero(top == 0)
                h[i, j] = np.sign(i + (j - (len(low) - ties)) - (ties - 1))
                out.append(float(np.median(h)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["col", "mc"])

    # At most MEDCOUPLE_SAMPLE values a column.
    return nums.sparkSession.createDataFrame(list(samples.items()), "col string, x array<double>").mapInArrow(kernel, "col string, mc double")


def fences(shape: DataFrame) -> DataFrame:
    """shape: col, q1, q3, mc. Skew-adjusted outlier fences."""
    iqr, mc = F.col("q3") - F.col("q1"), F.col("mc")
    low = F.when(mc >= 0, F.col("q1") - 1.5 * F.exp(-4 * mc) * iqr).otherwise(F.col("q1") - 1.5 * F.exp(-3 * mc) * iqr)
    high = F.when(mc >= 0, F.col("q3") + 1.5 * F.exp(3 * mc) * iqr).otherwise(F.col("q3") + 1.5 * F.exp(4 * mc) * iqr)
    return shape.select("*", low.alias("fence_low"), high.alias("fence_high"))


def outliers(nums: DataFrame, limits: DataFrame) -> DataFrame:
    """(col, outliers): values outside the fences; 0 for columns with 10 distinct values or fewer."""
    joined = nums.join(F.broadcast(limits.select("col", "fence_low", "fence_high")), "col")
    outside = F.sum(F.when((F.col("num") < F.col("fence_low")) | (F.col("num") > F.col("fence_high")), F.col("n")).otherwise(0))
    return joined.groupBy("col").agg(F.when(F.count("*") > 10, outside).otherwise(F.lit(0)).alias("outliers"))


def histogram(nums: DataFrame, bins: int = 10) -> DataFrame:
    """(col, bin, low, high, n): equal-width bins, the last one closed; one bin where all values are equal. Empty bins are left out."""
    ends = nums.groupBy("col").agg(F.min("num").alias("lo"), F.max("num").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor((F.col("num") - F.col("lo")) / F.when(width > 0, width).otherwise(F.lit(1.0))), F.lit(bins - 1))).cast("int")
    rows = nums.join(F.broadcast(ends), "col").select("col", at.alias("bin"), "lo", "hi", width.alias("w"), "n")
    return rows.groupBy("col", "bin", "lo", "hi", "w").agg(F.sum("n").alias("n")).select("col", "bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), F.when(F.col("hi") == F.col("lo"), F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), "n")


def statistics(counts: DataFrame, columns: list[str] | None = None, most: int | None = None) -> DataFrame:
    """One row a numeric column: moments, quartiles, medcouple, fences, outliers and a skew label. Computed when called.

    most: the medcouple is that of at most so many evenly spaced order statistics, from one selection with the quartiles; otherwise of all values.
    """
    nums = numbers(counts.where(F.col("col").isin(*columns)) if columns else counts).persist()
    known, probs = sizes(nums), {"q1": 0.25, "median": 0.5, "q3": 0.75}
    found = select_places(nums, {c: quantile_places(probs, m) | (spaced_places(m, most) if most else {}) for c, (_, m) in known.items()}, known)
    quartiles = {c: interpolated(probs, known[c][1], p) for c, p in found.items()}
    q = nums.sparkSession.createDataFrame([(c, *p.values()) for c, p in quartiles.items()], "col string, q1 double, median double, q3 double")
    if most:
        mc = medcouples(nums, {c: [p[k] for k in sorted(p) if k.isdigit()] for c, p in found.items()})
    else:
        mc = nums.sparkSession.createDataFrame(list(medcouple_of_all(nums, {c: p["median"] for c, p in quartiles.items()}, {c: m for c, (_, m) in known.items()}).items()), "col string, mc double")
    shape = fences(q.join(mc, "col"))
    rows = shape.collect()  # a row a column
    shape = nums.sparkSession.createDataFrame(rows, shape.schema)
    size = F.abs("skew")
    label = F.when(size < 0.5, "Low").when(size <= 1, "Moderate").otherwise("High")
    out = moments(nums).join(shape, "col").join(outliers(nums, shape), "col").withColumn("iqr", F.col("q3") - F.col("q1")).withColumn("skew_label", label)
    rows = out.collect()
    nums.unpersist()
    return counts.sparkSession.createDataFrame(rows, out.schema)
