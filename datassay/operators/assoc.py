"""Associations of pairs of columns, over rows complete in both.

Wide sums give all Pearson pairs in one pass; contingency tables are grouped counts, of which only observed
cells exist; ranks come from counts by value, so ties and hot values cost one row each.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cells import family, number, to_cell, typed_key
from ..functions.order import SLOT_ROWS, average_rank_table, select_places, sizes
from ..functions.special import chi2_tail, correlation_p


def frame(df: DataFrame, numeric: list[str] = (), categorical: list[str] = ()) -> DataFrame:
    """df's named columns as numbers or keys, missing cells null."""

    def value(c: str) -> Column:
        if family(df, c) in ("double", "bigint"):
            x = F.col(f"`{c}`").cast("double")
            return F.when(F.abs(x) < float("inf"), x)  # a typed number needs no parsing
        return number(to_cell(df, c))

    return df.select(*[value(c).alias(c) for c in numeric], *[typed_key(df, c).alias(c) for c in categorical])


#: Pairs that one aggregation sums; more are summed as matrices of batches.
PAIRS = 780


def pearson_pairs(wide: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, n, r) for every pair of number columns, in one pass; values are centred first, against cancellation."""
    means = wide.agg(*[F.avg(f"`{c}`").alias(c) for c in columns]).first()
    centred = wide.select(*[(F.col(f"`{c}`") - F.lit(means[c] if means[c] is not None else 0.0)).alias(c) for c in columns])
    if len(columns) * (len(columns) - 1) // 2 > PAIRS:
        return pairs_by_batch(centred, columns)
    aggs = []
    for i, j in combinations(range(len(columns)), 2):
        x, y = F.col(f"`{columns[i]}`"), F.col(f"`{columns[j]}`")
        both = x.isNotNull() & y.isNotNull()
        on = lambda v: F.sum(F.when(both, v))  # noqa: E731, B023
        aggs.append(F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.count(F.when(both, 1)).alias("n"), on(x).alias("sx"), on(y).alias("sy"), on(x * x).alias("xx"), on(y * y).alias("yy"), on(x * y).alias("xy")).alias(f"p{i}_{j}"))
    if not aggs:
        return wide.sparkSession.createDataFrame([], "a string, b string, n bigint, r double")
    one = centred.agg(*aggs)
    rows = one.select(F.explode(F.array(*[F.col(c) for c in one.columns])).alias("p")).select("p.*")
    return rows.select("a", "b", "n", correlation(F.col("n"), F.col("sx"), F.col("sy"), F.col("xx"), F.col("yy"), F.col("xy")).alias("r"))


def pairs_by_batch(centred: DataFrame, columns: list[str]) -> DataFrame:
    """pearson_pairs() of any number of columns: products of a task's batches, a row a pair and task, are added up."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        total = None
        for batch in batches:
            x = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns])
            there = ~np.isnan(x)
            r, t = np.where(there, x, 0.0), there.astype(float)
            own = [t.T @ t, r.T @ t, (r * r).T @ t, r.T @ r]
            total = own if total is None else [a + b for a, b in zip(total, own)]
        if total is not None:
            i, j = np.triu_indices(len(columns), 1)
            n, s, q, p = total
            cols = (i.astype(np.int32), j.astype(np.int32), n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], p[i, j])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["i", "j", "n", "sx", "sy", "xx", "yy", "xy"])

    sums = centred.toDF(*[f"v{i}" for i in range(len(columns))]).mapInArrow(work, "i int, j int, n double, sx double, sy double, xx double, yy double, xy double")
    one = sums.groupBy("i", "j").agg(F.sum("n").cast("bigint").alias("n"), *[F.sum(c).alias(c) for c in ("sx", "sy", "xx", "yy", "xy")])
    names = F.array(*[F.lit(c) for c in columns])
    return one.select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), "n", correlation(*[F.col(k) for k in ("n", "sx", "sy", "xx", "yy", "xy")]).alias("r"))


def pearson_with(wide: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(a, n, r) of each column with the target, in one aggregation."""
    mine = [*columns, target]
    means = wide.agg(*[F.avg(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(mine)]).first()
    x = [F.col(f"`{c}`") - F.lit(means[i] if means[i] is not None else 0.0) for i, c in enumerate(mine)]
    aggs, y = [], x[-1]
    for i, c in enumerate(columns):
        both = x[i].isNotNull() & y.isNotNull()
        on = lambda v: F.sum(F.when(both, v))  # noqa: E731, B023
        aggs.append(F.struct(F.lit(c).alias("a"), F.count(F.when(both, 1)).alias("n"), on(x[i]).alias("sx"), on(y).alias("sy"), on(x[i] * x[i]).alias("xx"), on(y * y).alias("yy"), on(x[i] * y).alias("xy")).alias(f"p{i}"))
    one = wide.agg(*aggs)
    rows = one.select(F.explode(F.array(*[F.col(c) for c in one.columns])).alias("p")).select("p.*")
    return rows.select("a", "n", correlation(*[F.col(k) for k in ("n", "sx", "sy", "xx", "yy", "xy")]).alias("r"))


def correlation(n: Column, sx: Column, sy: Column, xx: Column, yy: Column, xy: Column) -> Column:
    """Pearson's r from sums; 0 under 3 rows or without variance."""
    vx, vy = xx - sx * sx / n, yy - sy * sy / n
    r = F.try_divide(xy - sx * sy / n, F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0))))
    flat = (vx <= 1e-12 * xx) | (vy <= 1e-12 * yy)
    return F.when((n < 3) | flat | r.isNull(), F.lit(0.0)).otherwise(F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))


#: Distinct values of all pairs whose ranks are broadcast; beyond, only those of values that meet very many others are.
FEW_RANKS = 200_000


def met(wide: DataFrame, pairs: list[tuple[str, str]], kind: str = "double") -> DataFrame:
    """(i, x, y, o): how often two cells meet, for pairs of a number column and one of this kind, from one pass; rows complete in both."""
    each = F.array(*[F.struct(F.lit(str(i)).alias("i"), (F.col(f"`{a}`").cast("double") + F.lit(0.0)).alias("x"), F.col(f"`{b}`").cast(kind).alias("y")) for i, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(each).alias("e")).select("e.*").where("x is not null and y is not null").groupBy("i", "x", "y").agg(F.count("*").alias("o"))


def with_ranks(cells: DataFrame, side: str, few: int | None = None, hot: int | None = None):
    """(cells with r<side>, {i: rows}, what frees the table): average ranks of a side, about their middle, looked up by value and not by row.

    A value that meets `hot` others or more is told by a broadcast, so no task gets all of its cells; at most a value for each so many cells.
    """
    nums = cells.groupBy(F.col("i").alias("col"), F.col(side).alias("num")).agg(F.sum("o").alias("n"), F.count("*").alias("cells")).persist()
    known, hot = sizes(nums), SLOT_ROWS if hot is None else hot
    middle = F.coalesce(F.element_at(F.create_map(*[v for c, (_, m) in known.items() for v in (F.lit(c), F.lit((m + 1) / 2))]), F.col("col")), F.lit(0.0)) if known else F.lit(0.0)
    ranks = average_rank_table(nums, known, ["cells"]).select(F.col("col").alias("i"), F.col("num").alias(side), (F.col("rank") - middle).alias(f"r{side}"), "cells")
    on = ["i", side]
    if sum(d for d, _ in known.values()) <= (FEW_RANKS if few is None else few):
        out = cells.join(F.broadcast(ranks.drop("cells")), on)
    else:
        wide, narrow = F.broadcast(ranks.where(F.col("cells") >= hot).drop("cells")), ranks.where(F.col("cells") < hot).drop("cells")
        out = cells.join(wide, on).unionByName(cells.join(wide.select(*on), on, "left_anti").join(narrow, on))
    return out, {c: m for c, (_, m) in known.items()}, nums.unpersist


def spearmans(wide: DataFrame, pairs: list[tuple[str, str]], few: int | None = None, hot: int | None = None) -> DataFrame:
    """(a, b, n, rho) of pairs of number columns: ranks are taken over the rows complete in both. Computed when called."""
    cells = met(wide, pairs).persist()
    one, rows, free_x = with_ranks(cells, "x", few, hot)
    both, _, free_y = with_ranks(one, "y", few, hot) if rows else (None, {}, lambda: None)
    found = {}
    if rows:
        o, x, y = F.col("o").cast("double"), F.col("rx"), F.col("ry")
        s = both.groupBy("i").agg(F.sum(o).alias("n"), F.sum(o * x).alias("sx"), F.sum(o * y).alias("sy"), F.sum(o * x * x).alias("xx"), F.sum(o * y * y).alias("yy"), F.sum(o * x * y).alias("xy"))
        found = {r["i"]: (int(r["n"]), r["rho"]) for r in s.select("i", "n", correlation(*[F.col(c) for c in ("n", "sx", "sy", "xx", "yy", "xy")]).alias("rho")).collect()}  # a row a pair
    for free in (free_x, free_y, cells.unpersist):
        free()
    return wide.sparkSession.createDataFrame([(a, b, *found.get(str(i), (0, 0.0))) for i, (a, b) in enumerate(pairs)], "a string, b string, n bigint, rho double")


def spearman(wide: DataFrame, a: str, b: str) -> DataFrame:
    """spearmans() of one pair."""
    return spearmans(wide, [(a, b)])


def eta(groups: DataFrame) -> DataFrame:
    """(n, k, eta2) from (g, value) rows: between-group over total sum of squares."""
    by = groups.groupBy("g").agg(F.count("*").alias("m"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    t = by.agg(F.sum("m").alias("n"), F.count("*").alias("k"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("m")).alias("b"))
    return t.select("n", "k", between(t).alias("eta2"))


def between(t: DataFrame) -> Column:
    """Between-group over total sum of squares, from n, k, s, q and b."""
    mean2 = F.try_divide(t["s"] * t["s"], t["n"])
    return F.when((t["n"] < 3) | (t["k"] < 2), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(t["b"] - mean2, t["q"] - mean2), F.lit(0.0)))


def correlation_ratio(wide: DataFrame, value: str, group: str) -> DataFrame:
    rows = wide.select(F.col(f"`{group}`").alias("g"), F.col(f"`{value}`").alias("value")).where("g is not null and value is not null")
    return eta(rows).select(F.lit(value).alias("value"), F.lit(group).alias("group"), "n", "k", F.sqrt(F.greatest("eta2", F.lit(0.0))).alias("eta"))


def rank_etas(wide: DataFrame, pairs: list[tuple[str, str]], few: int | None = None, hot: int | None = None) -> DataFrame:
    """(value, group, n, k, h, effect, p) of pairs: Kruskal-Wallis as a correlation ratio over ranks, corrected for the number of groups. Computed when called."""
    spark = wide.sparkSession
    cells = met(wide, pairs, "string").persist()
    ranked, rows, free = with_ranks(cells, "x", few, hot)
    o, v = F.col("o"), F.col("rx")
    by = ranked.groupBy("i", "y").agg(F.sum(o).alias("m"), F.sum(o * v).alias("s"), F.sum(o * v * v).alias("q"))
    t = by.groupBy("i").agg(F.sum("m").alias("n"), F.count("*").alias("k"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("m")).alias("b"))
    sums = {r["i"]: (r["n"], r["k"], r["s"], r["q"], r["b"]) for r in t.collect()} if rows else {}  # a row a pair
    free()
    cells.unpersist()
    one = spark.createDataFrame([(a, b, *sums.get(str(i), (0, 0, None, None, None))) for i, (a, b) in enumerate(pairs)], "value string, group string, n bigint, k bigint, s double, q double, b double")
    one = one.select("value", "group", "n", "k", between(one).alias("eta2"))
    h = (F.col("n") - 1) * F.col("eta2")
    ok = (F.col("n") >= 3) & (F.col("k") >= 2) & (F.col("n") > F.col("k"))
    effect = F.sqrt(F.greatest(F.try_divide(h - F.col("k") + 1, F.col("n") - F.col("k")), F.lit(0.0)))
    return one.select("value", "group", "n", "k", F.when(ok, h).alias("h"), F.when(ok, effect).alias("effect"), F.when(ok, chi2_tail(h, (F.col("k") - 1).cast("double"))).alias("p"))


def rank_eta(wide: DataFrame, value: str, group: str) -> DataFrame:
    """rank_etas() of one pair."""
    return rank_etas(wide, [(value, group)])


def contingency(wide: DataFrame, a: str, b: str) -> DataFrame:
    """(x, y, o): observed cells of two key columns."""
    return wide.select(F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")).where("x is not null and y is not null").groupBy("x", "y").agg(F.count("*").alias("o"))


def with_margins(table: DataFrame) -> DataFrame:
    """(x, y, o, rx, cy): cells with their row and column totals."""
    total = lambda c: F.sum("o").over(Window.partitionBy(c))
    return table.select("x", "y", "o", total("x").alias("rx"), total("y").alias("cy"))


def margin_sums(cells: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by..., n, r, c, cells, chi2, hx, hy, hxy) of contingency cells with margins: everything is a sum over observed cells.

    The whole table's chi-squared is n * (sum of o^2 / (rx * cy) - 1); a row's own terms are dealt over its cells as o / rx.
    """
    o, rx, cy = (F.col(k).cast("double") for k in ("o", "rx", "cy"))
    t = cells.groupBy(*by).agg(
        F.sum("o").alias("n"), F.floor(F.sum(o / rx) + 0.5).alias("r"), F.floor(F.sum(o / cy) + 0.5).alias("c"), F.count("*").alias("cells"),
        F.sum(o * o / (rx * cy)).alias("s"), F.sum(o * F.log(rx)).alias("lx"), F.sum(o * F.log(cy)).alias("ly"), F.sum(o * F.log(o)).alias("lo"),
    )
    n = F.col("n").cast("double")
    return t.select(*by, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("c", F.lit(0)).alias("c"), "cells", F.greatest(n * (F.col("s") - 1), F.lit(0.0)).alias("chi2"), *[(F.log(n) - F.try_divide(F.col(k), n)).alias(h) for k, h in (("lx", "hx"), ("ly", "hy"), ("lo", "hxy"))])


def cramers_columns(t: DataFrame, keep: list[str]) -> DataFrame:
    """keep..., n, r, c, chi2, v, p from margin_sums(): V bias-corrected, p of the plain chi-squared."""
    n, r, c = F.col("n").cast("double"), F.col("r").cast("double"), F.col("c").cast("double")
    phi = F.greatest(F.try_divide(F.col("chi2"), n) - (r - 1) * (c - 1) / F.nullif(n - 1, F.lit(0.0)), F.lit(0.0))
    rt, ct = r - (r - 1) * (r - 1) / F.nullif(n - 1, F.lit(0.0)), c - (c - 1) * (c - 1) / F.nullif(n - 1, F.lit(0.0))
    small = F.least(rt - 1, ct - 1)
    ok = (n >= 5) & (r >= 2) & (c >= 2)
    v = F.when(small <= 0, F.lit(0.0)).otherwise(F.sqrt(F.try_divide(phi, small)))
    return t.select(*keep, "n", "r", "c", F.when(ok, F.col("chi2")).alias("chi2"), F.when(ok, v).alias("v"), F.when(ok, chi2_tail(F.col("chi2"), (r - 1) * (c - 1))).alias("p"))


def cramers_v(wide: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, r, c, chi2, v, p): chi-squared over the whole table, empty cells in closed form; V bias-corrected; p of the plain chi-squared."""
    t = margin_sums(with_margins(contingency(wide, a, b)))
    return cramers_columns(t.withColumns({"a": F.lit(a), "b": F.lit(b)}), ["a", "b"])


def odds_ratio(rows: DataFrame) -> DataFrame:
    """(n, odds, low, high, lift) from (exposed, outcome) booleans: Wald interval; 0.5 added to each cell only if one is empty."""
    on, off = F.col("exposed"), ~F.col("exposed")
    yes, no = F.col("outcome"), ~F.col("outcome")
    cnt = lambda c: F.count(F.when(c, 1)).cast("double")
    t = rows.agg(cnt(on & yes).alias("a"), cnt(on & no).alias("b"), cnt(off & yes).alias("c"), cnt(off & no).alias("d"))
    a, b, c, d = (F.col(x) for x in "abcd")
    n = a + b + c + d
    ok = (n >= 20) & (a + b > 0) & (c + d > 0) & (a + c > 0) & (b + d > 0)
    add = F.when((a == 0) | (b == 0) | (c == 0) | (d == 0), 0.5).otherwise(0.0)
    a1, b1, c1, d1 = a + add, b + add, c + add, d + add
    odds = F.try_divide(a1 * d1, b1 * c1)
    se = F.sqrt(F.try_divide(F.lit(1.0), a1) + F.try_divide(F.lit(1.0), b1) + F.try_divide(F.lit(1.0), c1) + F.try_divide(F.lit(1.0), d1))
    lift = F.try_divide(F.try_divide(a, a + b), F.try_divide(c, c + d))
    return t.select(n.cast("bigint").alias("n"), F.when(ok, odds).alias("odds"), F.when(ok, F.exp(F.log(odds) - 1.96 * se)).alias("low"), F.when(ok, F.exp(F.log(odds) + 1.96 * se)).alias("high"), F.when(ok, lift).alias("lift"))


def information_columns(t: DataFrame, keep: list[str]) -> DataFrame:
    """keep..., n, mi, normalised from margin_sums(): Miller-Madow entropies of both columns and the pair."""
    n = F.col("n").cast("double")
    corrected = lambda h, k: F.col(h) + (F.col(k) - 1) / (2.0 * F.nullif(n, F.lit(0.0)))
    t = t.select(*keep, "n", corrected("hx", "r").alias("ha"), corrected("hy", "c").alias("hb"), corrected("hxy", "cells").alias("hj"))
    mi = F.greatest(F.col("ha") + F.col("hb") - F.col("hj"), F.lit(0.0))
    # Sums of logarithms leave a rounding error where an entropy is 0.
    ok = (F.col("n") >= 10) & (F.col("ha") > 1e-12) & (F.col("hb") > 1e-12)
    return t.select(*keep, "n", F.when(ok, mi).alias("mi"), F.when(ok, F.least(F.lit(1.0), F.try_divide(mi, F.least("ha", "hb")))).alias("normalised"))


def mutual_information(wide: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, mi, normalised): normalised by the smaller entropy, at most 1."""
    t = margin_sums(with_margins(contingency(wide, a, b)))
    return information_columns(t.withColumns({"a": F.lit(a), "b": F.lit(b)}), ["a", "b"])


BINS = 8


def discretised(df: DataFrame, column: str, numeric: bool) -> DataFrame:
    """binned() of one column."""
    return binned(df, {column: numeric})


def binned(df: DataFrame, columns: dict[str, bool]) -> DataFrame:
    """df with columns {name: numeric} in quantile bins (number of edges at or below a value; edges at places floor(i * n / 8)) where numeric with more than 8 distinct values, else their keys.

    Cells that are no numbers go to bin 0 and missing cells are a level of their own; over all rows. Edges of all columns come from one pass.
    """
    numeric = [c for c, yes in columns.items() if yes]
    edges: dict[str, list[float]] = {}
    if numeric:
        each = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("double").alias("num")) for c in numeric])
        nums = df.select(F.explode(each).alias("e")).select("e.*").where("num is not null").groupBy("col", "num").agg(F.count("*").alias("n")).persist()
        known = sizes(nums)
        found = select_places(nums, {c: {str(i): i * m // BINS for i in range(1, BINS)} for c, (d, m) in known.items() if d > BINS}, known)
        nums.unpersist()
        edges = {c: sorted(p.values()) for c, p in found.items()}  # seven a column
    for c in columns:
        x = F.col(f"`{c}`").cast("double")
        df = df.withColumn(c, F.when(x.isNull(), F.lit("")).otherwise(bin_of(x, edges[c])) if c in edges else F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))
    return df


def bin_of(x: Column, edges: list[float], first: int = 0) -> Column:
    """The number of edges at or below x, as text, by a tree of comparisons."""
    if not edges:
        return F.lit(str(first))
    mid = len(edges) // 2
    return F.when(x < edges[mid], bin_of(x, edges[:mid], first)).otherwise(bin_of(x, edges[mid + 1 :], first + mid + 1))


def confidence(p: Column) -> Column:
    return F.when(p < 0.001, "reliable").when(p < 0.05, "moderate").otherwise("unreliable")


def matrix(wide: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, n, r, p, confidence, strength): every pair, r to 2 digits."""
    from ..functions.cells import half_up

    pairs = pearson_pairs(wide, columns)
    p = correlation_p(F.col("r"), F.col("n"))
    size = F.abs(F.col("r"))
    strength = F.when(size > 0.7, "strong").when(size > 0.4, "moderate").otherwise("weak")
    return pairs.select("a", "b", "n", half_up(F.col("r"), 2).alias("r2"), "r", p.alias("p"), confidence(p).alias("confidence"), strength.alias("strength"))


def clusters(pairs: DataFrame, least: float = 0.7) -> DataFrame:
    """(col, partners): columns with two or more partners at |r| >= least."""
    strong = pairs.where(F.abs("r") >= least)
    both = strong.select(F.col("a").alias("col")).union(strong.select(F.col("b").alias("col")))
    return both.groupBy("col").agg(F.count("*").alias("partners")).where("partners >= 2")
