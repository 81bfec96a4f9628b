"""Orders of whole columns without a task that sorts one: a directory of cut points says which slot a value is in, then ranks go inside a slot.

A directory has a cut for every SLOT_ROWS rows, however many that are: a first level of at most FAN slots from a bounded
sample, and, where there are more rows, cuts of each of these slots from samples that stay in tasks; 8 bytes a slot reach the driver.
Selection of single places narrows intervals instead, as only what holds a place has to be sorted. Samples are by
hash; they decide only where work goes, and all results are exact.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: So many rows make a slot; so many slots a level has; so many sampled values say where a slot ends.
SLOT_ROWS, FAN, PER_SLOT = 100_000, 1024, 32
#: Up to so many cuts a slot is told by comparisons; beyond, by a search over Arrow batches.
COMPARED = 63
SCALE = 1 << 40


@dataclass
class Directory:
    """cuts: ascending; heavy: those that are single values of about a slot's rows or more; rows: that it was made for."""

    cuts: np.ndarray
    heavy: np.ndarray
    rows: int

    def slot(self, value: Column) -> Column:
        """How many cuts are below value."""
        return searched(value, self.cuts)

    def hot(self, value: Column) -> Column:
        return value.isin([float(x) for x in self.heavy]) if len(self.heavy) else F.lit(False)


def compared(value: Column, cuts: np.ndarray, first: int = 0) -> Column:
    """The number of cuts below value by a tree of comparisons."""
    if not len(cuts):
        return F.lit(first)
    mid = len(cuts) // 2
    return F.when(value <= float(cuts[mid]), compared(value, cuts[:mid], first)).otherwise(compared(value, cuts[mid + 1 :], first + mid + 1))


def searched(value: Column, cuts: np.ndarray) -> Column:
    if len(cuts) <= COMPARED:
        return compared(value, cuts).cast("int")

    @F.pandas_udf("int")
    def find(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, v.to_numpy(np.float64), side="left").astype(np.int32))

    return find(value)


def some(share: float, *by: Column) -> Column:
    """About a share of the rows, by a hash of these columns."""
    return F.pmod(F.xxhash64(F.lit(5), *by), F.lit(SCALE)) < int(SCALE * min(1.0, share))


def cut_at(sample: np.ndarray, slots: int) -> np.ndarray:
    """The values that cut a sample into slots of equal size, with repeats."""
    sample = np.sort(sample)
    return sample[np.arange(1, slots) * len(sample) // slots] if len(sample) else sample


def directory(df: DataFrame, value: Column, chosen: Column | None = None) -> Directory:
    """The directory of a number column's rows; chosen: what the sample goes by, where values repeat."""
    rows = df.agg(F.count(value).alias("m")).first()["m"]
    slots = -(-rows // SLOT_ROWS)
    none = np.zeros(0)
    if slots <= 1:
        return Directory(none, none, rows)
    seen = df.where(value.isNotNull()).select(value.cast("double").alias("v"), (chosen if chosen is not None else value).alias("c"))
    first = min(slots, FAN)
    cuts = cut_at(np.array([r["v"] for r in seen.where(some(first * PER_SLOT / rows, F.col("c"))).select("v").collect()], np.float64), first)
    if slots > FAN:
        per, level = PER_SLOT, np.unique(cuts)

        def fine(table):
            import pyarrow as pa

            v = table["v"].to_numpy()
            return pa.table({"v": pa.array(cut_at(v, max(1, len(v) // per)))})

        more = seen.where(some(slots * PER_SLOT / rows, F.col("c"))).select(searched(F.col("v"), level).alias("slot"), "v").groupBy("slot").applyInArrow(fine, "v double")
        cuts = np.sort(np.concatenate([cuts, np.array([r["v"] for r in more.collect()], np.float64)]))  # a row a slot
    unique, times = np.unique(cuts, return_counts=True)
    # Cuts of the first level repeat in the second, so one repeat says nothing there.
    return Directory(unique, unique[times > (1 if slots <= FAN else 2)], rows)


def before_slots(counts: DataFrame, amounts: list[str], order: list[str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """counts (a row a slot) with before_<amount>: the sums of the slots before."""
    w = Window.partitionBy(*by).orderBy(*order)
    return counts.select(*by, *order, *[(F.sum(a).over(w) - F.col(a)).alias(f"before_{a}") for a in amounts])


def ordinals(df: DataFrame, value: Column, tie: Column, by: list[str] = [], last: list[Column] = []) -> DataFrame:  # noqa: B006
    """df with rn (1-based, by value, then tie, numbers both, then last) and rows, the number of rows with a value; by: rows are ordered by these columns first.

    Where one value has very many rows, their ties decide the slot.
    """
    seen = df.withColumn("datassay_v", value.cast("double")).withColumn("datassay_t", tie.cast("double")).where("datassay_v is not null")
    v, t = F.col("datassay_v"), F.col("datassay_t")
    main = directory(seen, v, t)
    ties = directory(seen.where(main.hot(v)), t) if len(main.heavy) else Directory(np.zeros(0), np.zeros(0), 0)
    hot = main.hot(v)
    slots = ["datassay_s", "datassay_h", "datassay_u"]
    placed = seen.withColumn("datassay_s", main.slot(v)).withColumn("datassay_h", hot.cast("int")).withColumn("datassay_u", F.when(hot, ties.slot(t)).otherwise(F.lit(0)) if len(main.heavy) else F.lit(0))
    counts = placed.groupBy(*by, *slots).agg(F.count("*").alias("n"))
    w = Window.orderBy(*by, *slots)
    before = counts.select(*[F.col(c).alias(f"{c}_") for c in (*by, *slots)], (F.sum("n").over(w) - F.col("n")).alias("datassay_before"))
    on = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in (*by, *slots)]
    held = placed.join(before, on).drop(*[f"{c}_" for c in (*by, *slots)])
    rn = F.col("datassay_before") + F.row_number().over(Window.partitionBy(*by, *slots).orderBy(v, t, *last))
    return held.withColumn("rows", F.lit(main.rows).cast("bigint")).withColumn("rn", rn).drop("datassay_v", "datassay_t", "datassay_before", *slots)


def sizes(nums: DataFrame) -> dict[str, tuple[int, int]]:
    """{col: (distinct values, rows)} of (col, num, n)."""
    return {r["col"]: (r["d"], r["m"]) for r in nums.groupBy("col").agg(F.count("*").alias("d"), F.sum("n").alias("m")).collect()}  # a row a column


def directories(nums: DataFrame, known: dict[str, tuple[int, int]]) -> dict[str, np.ndarray]:
    """{col: cuts} for ranking all of (col, num, n): as directory(), all columns at once."""
    slots = {c: -(-d // SLOT_ROWS) for c, (d, _) in known.items()}
    first = {c: min(k, FAN) for c, k in slots.items() if k > 1}
    cuts: dict[str, np.ndarray] = {c: np.zeros(0) for c in known}

    def share(of: dict[str, int]) -> Column:
        """Of each column, PER_SLOT values for each of these slots, by hash."""
        rate = functools.reduce(lambda rest, c: F.when(F.col("col") == c, int(SCALE * min(1.0, of[c] * PER_SLOT / known[c][0]))).otherwise(rest), of, F.lit(0))
        return F.pmod(F.xxhash64(F.lit(5), "num"), F.lit(SCALE)) < rate

    found: dict[str, list] = {}
    for r in nums.where(share(first)).select("col", "num").collect() if first else []:
        found.setdefault(r["col"], []).append(r["num"])
    for c, values in found.items():
        cuts[c] = np.unique(cut_at(np.array(values), first[c]))
    wide = {c: k for c, k in slots.items() if k > FAN}
    if wide:
        per = PER_SLOT

        def fine(table):
            import pyarrow as pa

            v = cut_at(table["num"].to_numpy(), max(1, len(table) // per))
            return pa.table({"col": pa.array([table["col"][0].as_py()] * len(v), pa.string()), "num": pa.array(v)})

        more = nums.where(share(wide)).select("col", "num", slot_of(cuts).alias("slot")).groupBy("col", "slot").applyInArrow(fine, "col string, num double")
        for r in more.collect():  # a row a slot
            cuts[r["col"]] = np.append(cuts[r["col"]], r["num"])
        cuts = {c: np.unique(x) for c, x in cuts.items()}
    return cuts


def average_rank_table(nums: DataFrame, known: dict[str, tuple[int, int]], also: list[str] = []) -> DataFrame:  # noqa: B006
    """(col, num, rank) of (col, num, n): each distinct value's average rank in its column; also: columns of nums that are kept."""
    placed = nums.withColumn("slot", slot_of(directories(nums, known)))
    before = before_slots(placed.groupBy("col", "slot").agg(F.sum("n").alias("m")), ["m"], ["slot"], ["col"])
    upto = F.col("before_m") + F.sum("n").over(Window.partitionBy("col", "slot").orderBy("num"))
    return placed.join(before, ["col", "slot"]).select("col", "num", (upto - (F.col("n") - 1) / 2).alias("rank"), *also)


def slot_of(cuts: dict[str, np.ndarray]) -> Column:
    """The slot of (col, num), each column by its own cuts."""
    own = {c: x for c, x in cuts.items() if len(x)}
    if not own:
        return F.lit(0)
    if sum(map(len, own.values())) <= COMPARED:
        return functools.reduce(lambda rest, c: F.when(F.col("col") == c, compared(F.col("num"), own[c])).otherwise(rest), own, F.lit(0)).cast("int")

    @F.pandas_udf("int")
    def find(col: pd.Series, num: pd.Series) -> pd.Series:
        out = np.zeros(len(col), np.int32)
        for c, at in col.groupby(col).indices.items():
            if c in own:
                out[at] = np.searchsorted(own[c], num.to_numpy()[at], side="left")
        return pd.Series(out)

    return find(F.col("col"), F.col("num"))


def select_places(nums: DataFrame, places: dict[str, dict[str, int]], known: dict[str, tuple[int, int]] | None = None) -> dict[str, dict[str, float]]:
    """{col: {name: value}}: the value at each 0-based place of each column's sorted values; nums: (col, num, n), distinct numbers, best cached.

    Bracketing selection, all columns at once: a sample cuts the intervals that hold places into parts, one pass counts them,
    and parts with more than two slots' values are cut again. What is left is sorted, each part by itself. Samples and cuts grow
    with the places asked, not the values.
    """
    known = known or sizes(nums)
    ask = {c: {k: int(v) for k, v in p.items() if 0 <= v < known[c][1]} for c, p in places.items() if c in known}
    ask = {c: p for c, p in ask.items() if p}
    if not ask:
        return {}
    mine = nums.where(F.col("col").isin(*ask))
    cuts: dict[str, np.ndarray] = {c: np.zeros(0) for c in ask}
    # Open intervals: (col, slot) -> distinct values.
    open_ = {(c, 0): known[c][0] for c in ask if known[c][0] > 2 * SLOT_ROWS}
    counts = None
    while open_:
        parts = {k: int(min(-(-d // SLOT_ROWS), max(16, FAN // len(open_)))) for k, d in open_.items()}
        spark = nums.sparkSession
        rate = spark.createDataFrame([(c, s, int(SCALE * min(1.0, parts[c, s] * PER_SLOT / d))) for (c, s), d in open_.items()], "c_ string, s_ int, rate bigint")
        cut = slot_of(cuts)
        drawn = mine.withColumn("slot", cut).join(F.broadcast(rate), (F.col("col") == F.col("c_")) & (F.col("slot") == F.col("s_")))  # a row a place
        found: dict[tuple, list] = {}
        for r in drawn.where(F.pmod(F.xxhash64(F.lit(5), "num"), F.lit(SCALE)) < F.col("rate")).select("col", "slot", "num").collect():
            found.setdefault((r["col"], r["slot"]), []).append(r["num"])
        before = {c: len(x) for c, x in cuts.items()}
        for (c, s), values in found.items():
            cuts[c] = np.concatenate([cuts[c], cut_at(np.array(values), parts[c, s])])
        cuts = {c: np.unique(x) for c, x in cuts.items()}
        counts = {}
        for r in mine.groupBy("col", slot_of(cuts).alias("slot")).agg(F.sum("n").alias("m"), F.count("*").alias("d")).collect():  # a row a part
            counts.setdefault(r["col"], {})[r["slot"]] = (r["m"], r["d"])
        held = located(ask, counts)
        grown = {c for c, x in cuts.items() if len(x) > before[c]}
        open_ = {(c, s): counts[c][s][1] for c, s in held if counts[c][s][1] > 2 * SLOT_ROWS and c in grown}
    held = located(ask, counts) if counts else {(c, 0): [(k, at) for k, at in p.items()] for c, p in ask.items()}
    spans, asked = [], []
    for (c, s), own in held.items():
        # A part's places are looked up by stretches of rows: about one place in each.
        b = max(1, (counts[c][s][0] if counts else known[c][1]) // len(own))
        spans.append((c, s, b))
        asked += [(c, s, at // b, at, k) for k, at in own]
    spark, upto = nums.sparkSession, F.sum("n").over(Window.partitionBy("col", "slot").orderBy("num"))
    inside = mine.withColumn("slot", slot_of(cuts)).join(F.broadcast(spark.createDataFrame(spans, "col string, slot int, b bigint")), ["col", "slot"])
    run = inside.select("col", "slot", "num", "b", (upto - F.col("n")).alias("low"), upto.alias("upto"))
    each = run.select("col", "slot", "num", "low", "upto", F.explode(F.sequence(F.floor(F.col("low") / F.col("b")), F.floor((F.col("upto") - 1) / F.col("b")))).alias("stretch"))
    places_ = F.broadcast(spark.createDataFrame(asked, "col string, slot int, stretch bigint, at bigint, name string"))  # the places asked for
    rows = each.join(places_, ["col", "slot", "stretch"]).where((F.col("at") >= F.col("low")) & (F.col("at") < F.col("upto"))).select("col", "name", F.col("num").alias("value")).collect()  # a row a place
    out: dict[str, dict[str, float]] = {}
    for r in rows:
        out.setdefault(r["col"], {})[r["name"]] = r["value"]
    return out


def located(ask: dict[str, dict[str, int]], counts: dict[str, dict[int, tuple[int, int]]]) -> dict[tuple[str, int], list[tuple[str, int]]]:
    """{(col, slot): [(name, place inside the slot)]} from the rows of each slot."""
    out: dict[tuple[str, int], list] = {}
    for c, own in ask.items():
        slots = sorted(counts[c])
        upto = np.cumsum([counts[c][s][0] for s in slots])
        for name, at in own.items():
            k = int(np.searchsorted(upto, at, side="right"))
            out.setdefault((c, slots[k]), []).append((name, int(at - (upto[k - 1] if k else 0))))
    return out
