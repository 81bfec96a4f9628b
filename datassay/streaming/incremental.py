"""Profiles of a stream: mergeable counts by column, kept up by foreachBatch; windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.cells import is_missing, number
from ..operators.profile import cells


def batch_sums(df: DataFrame) -> DataFrame:
    """(col, rows, missing, numeric, s, q): sums of one batch that add up over batches."""
    c = cells(df).withColumn("gone", is_missing(F.col("raw"))).withColumn("num", number(F.col("raw")))
    x = F.when(~F.col("gone"), F.col("num"))
    return c.groupBy("col").agg(F.count("*").alias("rows"), F.count(F.when(F.col("gone"), 1)).alias("missing"), F.count(x).alias("numeric"), F.coalesce(F.sum(x), F.lit(0.0)).alias("s"), F.coalesce(F.sum(x * x), F.lit(0.0)).alias("q"))


def profile_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's sums under its batch id: a batch that is run again replaces its own."""
    return stream.writeStream.foreachBatch(lambda df, i: batch_sums(df).write.mode("overwrite").parquet(f"{path}/batch={i}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(sums: DataFrame) -> DataFrame:
    """(col, rows, missing, numeric, mean, std) of all batches so far."""
    t = sums.groupBy("col").agg(*[F.sum(c).alias(c) for c in ("rows", "missing", "numeric", "s", "q")])
    var = F.try_divide(F.col("q") - F.col("s") * F.col("s") / F.nullif(F.col("numeric"), F.lit(0)), F.col("numeric") - 1)
    return t.select("col", "rows", "missing", "numeric", F.try_divide(F.col("s"), F.col("numeric")).alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"))


def windowed_counts(stream: DataFrame, ts: str, by: str, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window, by, n) with a watermark: rows later than `late` are dropped from state."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, every), by).agg(F.count("*").alias("n"))
