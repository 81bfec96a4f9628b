"""Time and train/test drift: periods, rates, late columns, overlap, population stability, Kolmogorov-Smirnov."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cells import family, is_missing, key, native, row_key, to_cell
from ..functions.order import before_slots, directory, ordinals
from ..functions.special import ks_tail

PERIODS = 5
EPS = 1e-4
BINS, TOP_LEVELS = 10, 20


def periods(df: DataFrame, ts: str, tie: str) -> DataFrame:
    """df with period 0 to 4: equal counts by time."""
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    return ordinals(df, seconds, F.col(tie)).withColumn("period", (F.ceil(PERIODS * F.col("rn") / F.col("rows")) - 1).cast("int"))


def period_table(placed: DataFrame, ts: str) -> DataFrame:
    return placed.groupBy("period").agg(F.count("*").alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end"))


def class_drift(placed: DataFrame, target: str, label: str) -> DataFrame:
    """(period, n, rate): share of the label in each period."""
    return placed.groupBy("period").agg(F.count("*").alias("n"), F.avg((F.col(target) == label).cast("double")).alias("rate"))


def mean_drift(placed: DataFrame, target: str) -> DataFrame:
    """(spread_sd, means): the range of the period means in standard deviations."""
    by = placed.groupBy("period").agg(F.avg(target).alias("m"), F.count(target).alias("n"), F.sum(target).alias("s"), F.sum(F.col(target) * F.col(target)).alias("q"))
    t = by.agg((F.max("m") - F.min("m")).alias("spread"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    sd = F.sqrt((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1))
    return t.select("spread", sd.alias("sd"), F.coalesce(F.try_divide(F.col("spread"), sd), F.lit(0.0)).alias("spread_sd"))


def late_columns(placed: DataFrame, columns: list[str]) -> DataFrame:
    """(col, early, late, is_late): missing shares of the first and last fifth by time; late: at least 0.9 and at most 0.5."""
    edge = F.floor(F.col("rows") / 5)
    each = F.array(*[F.struct(F.lit(c).alias("col"), is_missing(to_cell(placed, c)).cast("double").alias("gone")) for c in columns])
    rows = placed.select("rn", "rows", F.explode(each).alias("e")).select("e.col", "e.gone", (F.col("rn") <= edge).alias("first"), (F.col("rn") > F.col("rows") - edge).alias("last"))
    by = rows.groupBy("col").agg(F.coalesce(F.avg(F.when(F.col("first"), F.col("gone"))), F.lit(0.0)).alias("early"), F.coalesce(F.avg(F.when(F.col("last"), F.col("gone"))), F.lit(0.0)).alias("late"))
    return by.withColumn("is_late", (F.col("early") >= 0.9) & (F.col("late") <= 0.5))


def time_cutoff(df: DataFrame, ts: str, tie: str, share: float = 0.8) -> DataFrame:
    """The time at place floor(share * (n - 1))."""
    placed = ordinals(df, F.unix_micros(F.col(ts).cast("timestamp")) / 1e6, F.col(tie))
    return placed.where(F.col("rn") == F.floor(share * (F.col("rows") - 1)) + 1).select(F.col(ts).alias("cutoff"))


def row_overlap(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """(test_rows, copied): rows of test that train has too, null and empty alike."""
    text = {c for c in columns if family(train, c) != family(test, c)}
    keyed = lambda df: df.select(*row_key(df, columns, text))
    counts = keyed(test).groupBy("k1", "k2").agg(F.count("*").alias("n"))
    seen = keyed(train).distinct().withColumn("seen", F.lit(1))
    return counts.join(seen, ["k1", "k2"], "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("test_rows"), F.coalesce(F.sum(F.when(F.col("seen") == 1, F.col("n"))), F.lit(0)).alias("copied"))


def _levels(df: DataFrame, column: str, name: str) -> DataFrame:
    """(k, <name>): keys as text and how often they occur; native values are counted first."""
    counts = df.where(native(df, column).isNotNull()).groupBy(native(df, column).alias("v")).agg(F.count("*").alias("n"))
    cell = to_cell(counts, "v")
    return counts.where(~is_missing(cell)).select(key(cell).alias("k"), "n").groupBy("k").agg(F.sum("n").alias(name))


def entity_overlap(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """(test_rows, shared_rows, test_values, shared_values): values of an entity column in both tables."""
    both = _levels(test, column, "m").join(_levels(train, column, "n"), "k", "left")
    hit = F.col("n").isNotNull()
    return both.agg(F.sum("m").alias("test_rows"), F.coalesce(F.sum(F.when(hit, F.col("m"))), F.lit(0)).alias("shared_rows"), F.count("*").alias("test_values"), F.count(F.when(hit, 1)).alias("shared_values"))


def unseen_levels(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """(k, m): levels of test that train lacks."""
    return _levels(test, column, "m").join(_levels(train, column, "n"), "k", "left_anti")


def psi(bins: DataFrame) -> DataFrame:
    """(psi, psi_raw, bins) from (bin, e, a): counts of train and test. Shares are floored, empty bins left out, the sampling bias taken off."""
    bins = bins.where("e > 0 or a > 0")
    total = bins.agg(F.sum("e").cast("double").alias("n"), F.sum("a").cast("double").alias("m"))
    rows = bins.crossJoin(F.broadcast(total))  # one row
    e, a = F.greatest(F.col("e") / F.col("n"), F.lit(EPS)), F.greatest(F.col("a") / F.col("m"), F.lit(EPS))
    one = rows.agg(F.sum((a - e) * F.log(a / e)).alias("raw"), F.count("*").alias("bins"), F.max("n").alias("n"), F.max("m").alias("m"))
    bias = F.greatest(F.col("bins") - 1, F.lit(0)) * (1 / F.col("n") + 1 / F.col("m"))
    return one.select(F.greatest(F.col("raw") - bias, F.lit(0.0)).alias("psi"), F.col("raw").alias("psi_raw"), "bins")


def numeric_bins(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """(bin, e, a): deciles of train (places floor(b / 10 * (n - 1)), repeats dropped); a value goes to bin #(edges below it)."""
    from .stats import order_statistics

    def nums(df: DataFrame) -> DataFrame:
        x = F.col(f"`{column}`").cast("double")
        return df.where(x.isNotNull() & (F.abs(x) < float("inf"))).select(F.lit(column).alias("col"), x.alias("num")).groupBy("col", "num").agg(F.count("*").alias("n"))

    a, b = nums(train), nums(test)
    n = a.agg(F.sum("n").alias("n")).first()["n"] or 0
    spots = train.sparkSession.createDataFrame([(column, str(k), int(k / BINS * (n - 1))) for k in range(1, BINS)] if n else [], "col string, name string, at bigint")
    edges = sorted({r["value"] for r in order_statistics(a, spots).collect()})  # nine at most
    at = sum((F.when(F.col("num") > e, 1).otherwise(0) for e in edges), F.lit(0))
    count = lambda df, name: df.groupBy(at.alias("bin")).agg(F.sum("n").alias(name))
    return count(a, "e").join(count(b, "a"), "bin", "full").select("bin", F.coalesce("e", F.lit(0)).alias("e"), F.coalesce("a", F.lit(0)).alias("a"))


def level_bins(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """(bin, e, a): train's top levels, other levels of train, and levels that train lacks."""
    both = _levels(train, column, "e").join(_levels(test, column, "a"), "k", "full").select("k", F.coalesce("e", F.lit(0)).alias("e"), F.coalesce("a", F.lit(0)).alias("a"))
    top = both.where("e > 0").orderBy(F.desc("e"), "k").limit(TOP_LEVELS).select("k", F.lit(True).alias("top"))
    named = both.join(F.broadcast(top), "k", "left")
    bin_ = F.when(F.col("top"), F.concat(F.lit("="), "k")).when(F.col("e") > 0, "other").otherwise("unseen")
    return named.groupBy(bin_.alias("bin")).agg(F.sum("e").alias("e"), F.sum("a").alias("a"))


def ks_two_sample(one: DataFrame, two: DataFrame, column: str) -> DataFrame:
    """(d, p, n, m): the largest gap of the two step functions, both stepped past ties together."""
    tag = lambda df, a, b: df.where(F.col(f"`{column}`").isNotNull()).select(F.col(f"`{column}`").cast("double").alias("x"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    both = tag(one, 1, 0).unionByName(tag(two, 0, 1))
    ends = both.agg(F.sum("a").alias("n"), F.sum("b").alias("m")).first()
    placed = both.groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).select("x", "a", "b", directory(both, F.col("x")).slot(F.col("x")).alias("slot"))
    sums = placed.groupBy("slot").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    before = before_slots(sums, ["a", "b"], ["slot"])
    inside = Window.partitionBy("slot").orderBy("x")
    n, m = F.lit(float(ends["n"] or 1)), F.lit(float(ends["m"] or 1))
    gap = F.abs((F.col("before_a") + F.sum("a").over(inside)) / n - (F.col("before_b") + F.sum("b").over(inside)) / m)
    d = placed.join(before, "slot").select(gap.alias("gap")).agg(F.max("gap").alias("d"))
    return d.select("d", ks_tail(F.col("d"), n, m).alias("p"), n.cast("bigint").alias("n"), m.cast("bigint").alias("m"))


def missing_shift(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """(col, train, test, shift): missing shares in points, and whether they differ by 10 or more."""
    share = lambda df: df.agg(*[(F.avg(is_missing(to_cell(df, c)).cast("double")) * 100).alias(c) for c in columns])
    flat = lambda df, name: share(df).select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").alias(name)) for c in columns])).alias("e")).select("e.*")
    return flat(train, "train").join(flat(test, "test"), "col").withColumn("shift", F.abs(F.col("train") - F.col("test")) >= 10)
