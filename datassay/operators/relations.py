"""Scan of every column against a target: the measure follows from both roles, and what can't be measured gets a reason.

All contingency tables of a scan come from one exploded group-by, all Pearson pairs from one aggregation.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cells import half_up, is_missing, to_cell, typed_key
from ..functions.order import average_rank_table, sizes
from ..functions.special import correlation_p
from . import assoc
from .assoc import cramers_columns, frame, information_columns, margin_sums, odds_ratio

MEASURED = ("numeric", "binary", "categorical")
SKIPPED = {"identifier": "identifier", "temporal": "date", "text": "free text"}
LEAK, LEAK_RANK = 0.95, 0.9
PAIR_V, PRESENCE_V, PRESENCE_ROWS, PAIR_COLUMNS = 0.3, 0.3, 20, 25
WEAK, RARE = 0.3, 0.10
SCHEMA = "col string, metric string, n bigint, value double, abs_value double, rho double, p double, mi double, odds double, odds_low double, odds_high double, lift double, suspect boolean"


def coded(df: DataFrame, column: str) -> DataFrame:
    """df with a two-level column as 0 and 1, by sorted level: as numbers if both are, else as text; two levels reach the driver."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(3).collect()]
    if len(found) != 2:
        return df.withColumn(column, F.lit(None).cast("double"))
    try:
        found.sort(key=float)
    except (TypeError, ValueError):
        found.sort()
    return df.withColumn(column, F.when(F.col(column).isNull(), None).when(F.col(column) == found[0], 0.0).otherwise(1.0))


#: Cells that a task holds before it passes them on.
HELD_CELLS = 200_000


def contingencies(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(a, b, x, y, o): the observed cells of several pairs of key columns, from one pass over the rows; df: key columns by name.

    A task codes each column's values once a batch and counts pairs of codes, so a row is read once, not once a pair; its
    counts are summed with others' after.
    """
    names = sorted({c for p in pairs for c in p})
    at = [(names.index(a), names.index(b)) for a, b in pairs]

    def count(batches):
        held: dict[tuple, int] = {}

        def out():
            c = list(zip(*held)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.string()), pa.array(c[2], pa.string()), pa.array(list(held.values()), pa.int64())], names=["i", "x", "y", "o"])

        for batch in batches:
            coded = []
            for column in batch.columns:
                d = column.dictionary_encode()
                coded.append((d.indices.fill_null(-1).to_numpy().astype(np.int64), d.dictionary.to_pylist()))
            for i, (a, b) in enumerate(at):
                (x, xs), (y, ys) = coded[a], coded[b]
                both = (x >= 0) & (y >= 0)
                cells, times = np.unique(x[both] * len(ys) + y[both], return_counts=True)
                for cell, n in zip(cells.tolist(), times.tolist()):
                    k = (i, xs[cell // len(ys)], ys[cell % len(ys)])
                    held[k] = held.get(k, 0) + n
            if len(held) > HELD_CELLS:
                yield from out()
                held.clear()
        yield from out()

    cells = df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{j}") for j, c in enumerate(names)]).mapInArrow(count, "i int, x string, y string, o bigint").groupBy("i", "x", "y").agg(F.sum("o").alias("o"))
    name = lambda k: F.element_at(F.array(*[F.lit(p[k]) for p in pairs]), F.col("i") + 1)
    return cells.select(name(0).alias("a"), name(1).alias("b"), "x", "y", "o")


def pair_sums(cells: DataFrame) -> DataFrame:
    """margin_sums() of each pair."""
    total = lambda c: F.sum("o").over(Window.partitionBy("a", "b", c))  # noqa: E731  cells are few beside rows
    return margin_sums(cells.withColumn("rx", total("x")).withColumn("cy", total("y")), ["a", "b"])


def target_associations(df: DataFrame, roles: dict[str, str], target: str) -> DataFrame:
    """SCHEMA, a row for each measurable column: Pearson with Spearman's rho (and, where both are weak, mutual information; for two
    binary columns with a rare level, the odds ratio), rank eta, or Cramer's V; coefficients to 2 digits."""
    spark, goal = df.sparkSession, roles[target]
    own = [c for c in roles if c != target and roles[c] in MEASURED]
    if goal not in MEASURED or not own:
        return spark.createDataFrame([], SCHEMA)
    numeric = [c for c, r in roles.items() if r == "numeric"]
    categorical = [c for c, r in roles.items() if r in ("binary", "categorical")]
    wide = frame(df, numeric, categorical)
    like = lambda c: roles[c] in ("numeric", "binary")
    linear = [c for c in own if like(c) and like(target)]
    tables = [c for c in own if c not in linear and roles[c] != "numeric" and goal != "numeric"]
    rows: list[dict] = []
    half = lambda x: math.floor(x * 100 + 0.5) / 100
    two = lambda x: None if x is None else half(x)
    if linear:
        codes = wide
        for c in [c for c in (*linear, target) if roles[c] == "binary"]:
            codes = coded(codes, c)
        got = assoc.pearson_with(codes, linear, target).withColumn("p", correlation_p(F.col("r"), F.col("n"))).collect()
        there = [r["a"] for r in got if r["n"]]
        ranked = {r["a"]: r["rho"] for r in assoc.spearmans(codes, [(c, target) for c in there]).collect()} if there else {}
        weak = [r["a"] for r in got if abs(r["r"]) < WEAK and abs(ranked.get(r["a"]) or 0.0) < WEAK]
        shared: dict[str, float | None] = {}
        if weak:
            pairs = contingencies(assoc.binned(wide, {c: roles[c] == "numeric" for c in (*weak, target)}), [(c, target) for c in weak])
            shared = {r["a"]: r["normalised"] for r in information_columns(pair_sums(pairs), ["a"]).collect()}
        for r in got:
            c = r["a"]
            rho = ranked.get(c, 0.0)
            row = {"col": c, "metric": "pearson", "n": r["n"], "value": two(r["r"]), "abs_value": half(abs(r["r"])), "rho": two(rho), "p": r["p"]}
            if c in weak:
                row["mi"] = two(shared.get(c))
            if roles[c] == "binary" and goal == "binary":
                o = codes.where(F.col(c).isNotNull() & F.col(target).isNotNull())
                share = o.agg(F.avg(c).alias("m")).first()["m"]
                if share is not None and min(share, 1 - share) <= RARE:
                    exposed = (F.col(c) == 1.0) if share <= 0.5 else (F.col(c) == 0.0)
                    e = odds_ratio(o.select(exposed.alias("exposed"), (F.col(target) == 1.0).alias("outcome"))).first()
                    row |= {"odds": e["odds"], "odds_low": e["low"], "odds_high": e["high"], "lift": e["lift"]}
            rows.append(row)
    if tables:
        keyed = wide.select(*[F.col(f"`{c}`") for c in (*tables, target)])
        for r in cramers_columns(pair_sums(contingencies(keyed, [(c, target) for c in tables])), ["a", "b"]).collect():
            rows.append({"col": r["a"], "metric": "cramers_v", "n": r["n"], "value": two(r["v"]), "abs_value": two(r["v"]), "p": r["p"]})
    others = [(c, target) if roles[c] == "numeric" else (target, c) for c in own if c not in linear and c not in tables]
    for r in assoc.rank_etas(wide, others).collect() if others else []:
        c = r["group"] if r["value"] == target else r["value"]
        rows.append({"col": c, "metric": "rank_eta", "n": r["n"], "value": two(r["effect"]), "abs_value": two(r["effect"]), "p": r["p"]})
    order = {c: i for i, c in enumerate(roles)}
    for r in rows:
        a = r["abs_value"] or 0.0
        r["suspect"] = r["metric"] == "pearson" and a >= LEAK and abs(r["rho"] or 0.0) >= LEAK_RANK or r["metric"] == "cramers_v" and a >= LEAK
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(k) for k in names) for r in sorted(rows, key=lambda r: order[r["col"]])], SCHEMA)


def unscored(df: DataFrame, roles: dict[str, str], target: str, scored: DataFrame, presence: dict[str, float] | None = None) -> DataFrame:
    """(col, reason, verdict): why a column has no measure, from its rows complete with the target, and what its presence says. presence: V by column, where it was measured."""
    left = [c for c in roles if c != target and c not in {r["col"] for r in scored.where("value is not null").select("col").collect()}]
    if not left:
        return df.sparkSession.createDataFrame([], "col string, reason string, verdict string")
    t = typed_key(df, target)
    each = F.array(*[F.struct(F.lit(c).alias("col"), typed_key(df, c).cast("string").alias("x")) for c in left])
    flat = df.select(t.cast("string").alias("t"), F.explode(each).alias("e")).select("t", "e.*")
    facts = {r["col"]: r for r in flat.groupBy("col").agg(F.count("x").alias("present"), F.count_if(F.col("x").isNotNull() & F.col("t").isNotNull()).alias("n"), F.count_distinct(F.when(F.col("t").isNotNull(), F.col("x"))).alias("d"), F.count_distinct(F.when(F.col("x").isNotNull(), F.col("t"))).alias("td")).collect()}
    out = []
    for c in left:
        f = facts[c]
        if roles[c] in SKIPPED:
            reason = SKIPPED[roles[c]]
        elif not f["present"]:
            reason = "empty"
        elif roles[target] not in MEASURED:
            reason = "the target is a " + SKIPPED.get(roles[target], "kind that can't be scored")
        elif f["td"] < 2:
            reason = "the target has one value on the rows that have both"
        elif f["d"] < 2:
            reason = "one value on the rows that have both"
        elif f["n"] <= f["d"]:
            reason = "as many levels as rows"
        else:
            reason = f"only {f['n']} rows have both"
        v = (presence or {}).get(c)
        verdict = "not tested" if v is None else "possible leak" if v >= LEAK else "signal" if v >= PRESENCE_V else "no signal"
        out.append((c, reason, verdict))
    return df.sparkSession.createDataFrame(out, "col string, reason string, verdict string")


def presence_signals(df: DataFrame, columns: list[str], target: str, least: int = PRESENCE_ROWS) -> DataFrame:
    """(col, n, present_pct, v, p): whether a column's being filled says something about the target, for columns with `least` rows on either side; all in one pass."""
    each = F.array(*[F.struct(F.lit(c).alias("a"), F.when(is_missing(to_cell(df, c)), "absent").otherwise("present").alias("x")) for c in columns])
    flat = df.select(typed_key(df, target).cast("string").alias("y"), F.explode(each).alias("e")).where("y is not null").select("e.*", "y")
    cells = flat.groupBy("a", "x", "y").agg(F.count("*").alias("o")).withColumn("b", F.lit(target))
    sides = cells.groupBy("a").agg(F.sum(F.when(F.col("x") == "present", F.col("o")).otherwise(0)).alias("on"), F.sum(F.when(F.col("x") == "absent", F.col("o")).otherwise(0)).alias("off")).where((F.col("on") >= least) & (F.col("off") >= least))
    v = cramers_columns(pair_sums(cells), ["a", "b"]).where("v is not null")
    return v.join(F.broadcast(sides), "a").select(F.col("a").alias("col"), "n", half_up(100 * F.col("on") / (F.col("on") + F.col("off")), 2).alias("present_pct"), "v", "p")


def presence(df: DataFrame, column: str, target: str, least: int = PRESENCE_ROWS) -> DataFrame:
    """(col, n, v, p) of one column; null with fewer than `least` rows on a side."""
    one = presence_signals(df, [column], target, least)
    n = df.where(typed_key(df, target).isNotNull()).agg(F.count("*").alias("m"))
    return n.join(one, F.lit(True), "left").select(F.lit(column).alias("col"), F.coalesce("n", "m").alias("n"), "v", "p")  # one row


def categorical_pairs(df: DataFrame, columns: list[str], least: float = PAIR_V, most: int = PAIR_COLUMNS) -> DataFrame:
    """(a, b, n, r, c, v, p, finer): associated pairs of the first `most` categorical columns; finer: the column with three times the levels, which determines the other."""
    own = columns[:most]
    pairs = list(combinations(own, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, n bigint, r bigint, c bigint, v double, p double, finer string")
    keyed = df.select(*[typed_key(df, c).alias(c) for c in own])
    got = cramers_columns(pair_sums(contingencies(keyed, pairs)), ["a", "b"]).where(F.col("v") >= least)
    finer = F.when(F.greatest("r", "c") >= 3 * F.least("r", "c"), F.when(F.col("r") > F.col("c"), F.col("a")).otherwise(F.col("b")))
    return got.select("a", "b", "n", "r", "c", half_up(F.col("v"), 2).alias("v"), "p", finer.alias("finer"))


def strong_pairs(matrix: DataFrame, rank: DataFrame | None = None, least: float = 0.4, gap: float = 0.15) -> DataFrame:
    """(a, b, n, r, rho, direction, monotonic_not_linear), strongest first: numeric pairs of which |r| or |rho| is above `least`."""
    rows = matrix.join(rank.select("a", "b", "rho"), ["a", "b"], "left") if rank is not None else matrix.withColumn("rho", F.lit(None).cast("double"))
    size, ranked = F.abs("r"), F.abs(F.coalesce("rho", "r"))
    out = rows.where((size > least) | (ranked > least))
    direction = F.when(F.col("r") >= 0, "positive").otherwise("negative")
    return out.select("a", "b", "n", "r", "rho", direction.alias("direction"), (ranked - size > gap).alias("monotonic_not_linear")).orderBy(F.desc(F.abs("r")), "a", "b")


#: Distinct values of all columns whose ranks are looked up in tasks' memory, 16 bytes each; beyond, they are joined.
HELD_RANKS = 2_000_000


def spearman_matrix(wide: DataFrame, columns: list[str], held: int | None = None) -> DataFrame:
    """(a, b, n, rho) of all pairs over the rows that have both, each column ranked once over its own present values. Computed when called.

    Ranks come from one table of counts by column and value. Rows look them up and are summed into one Gram
    matrix; where the table is too large to be held, cells are joined with it and meet again by a hash of their row, which equal
    rows share and count by. Nothing rests on the order of rows.
    """
    spark, d = wide.sparkSession, len(columns)
    if d < 2:
        return spark.createDataFrame([], "a string, b string, n bigint, rho double")
    value = lambda c: F.col(f"`{c}`").cast("double") + F.lit(0.0)
    own = wide.select(*[F.when(~F.isnan(value(c)), value(c)).alias(f"v{i}") for i, c in enumerate(columns)])
    cells = F.explode(F.array(*[F.struct(F.lit(str(i)).alias("col"), F.col(f"v{i}").alias("num")) for i in range(d)])).alias("e")
    nums = own.select(cells).select("e.*").where("num is not null").groupBy("col", "num").agg(F.count("*").alias("n")).persist()
    known = sizes(nums)
    middle = {int(c): (m + 1) / 2 for c, (_, m) in known.items()}

    def sums(ranks: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Counts, sums, squares and products by pair; NaN where a cell is missing, ranks about their middle against cancellation."""
        there = ~np.isnan(ranks)
        r, m = np.where(there, ranks, 0.0), there * weight[:, None]
        return [there.T @ m, r.T @ m, (r * r).T @ m, (r * weight[:, None]).T @ r]

    def packed(total: list[np.ndarray]):
        i, j = np.triu_indices(d, 1)
        n, s, q, p = total
        cols = (i.astype(np.int32), j.astype(np.int32), n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], p[i, j])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["i", "j", "n", "sx", "sy", "xx", "yy", "xy"])

    schema = "i int, j int, n double, sx double, sy double, xx double, yy double, xy double"
    if sum(x for x, _ in known.values()) <= (HELD_RANKS if held is None else held):
        table: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        flat = nums.toArrow()  # at most HELD_RANKS rows
        of, v, n = np.array(flat["col"].to_pylist(), np.int64), flat["num"].to_numpy(), flat["n"].to_numpy()
        for i in range(d):
            at = np.flatnonzero(of == i)
            at = at[np.argsort(v[at])]
            upto = np.cumsum(n[at])
            table[i] = (v[at], upto - (n[at] - 1) / 2 - middle.get(i, 0.0))
        shared = spark.sparkContext.broadcast(table)

        def look_up(batches):
            total = [np.zeros((d, d)) for _ in range(4)]
            for batch in batches:
                ranks = np.full((batch.num_rows, d), np.nan)
                for i in range(d):
                    x = batch.column(i).to_numpy(zero_copy_only=False)
                    there = ~np.isnan(x)
                    values, rank = shared.value[i]
                    ranks[there, i] = rank[np.searchsorted(values, x[there])]
                total = [a + b for a, b in zip(total, sums(ranks, np.ones(len(ranks))))]
            yield packed(total)

        parts = own.mapInArrow(look_up, schema)
    else:
        hashed = own.withColumn("k1", F.xxhash64(*[x for i in range(d) for x in (F.col(f"v{i}"), F.isnull(f"v{i}"))])).withColumn("k2", F.xxhash64(F.lit(3), *[x for i in reversed(range(d)) for x in (F.isnull(f"v{i}"), F.col(f"v{i}"))]))
        each = hashed.select("k1", "k2", cells).select("k1", "k2", "e.*").where("num is not null").groupBy("k1", "k2", "col", "num").agg(F.count("*").alias("w"))
        ranked = each.join(average_rank_table(nums, known), ["col", "num"])
        rows = ranked.groupBy("k1", "k2").agg(F.max("w").cast("double").alias("w"), F.collect_list(F.struct(F.col("col").cast("int").alias("i"), "rank")).alias("r"))  # a cell a column

        def gather(batches):
            total = [np.zeros((d, d)) for _ in range(4)]
            for batch in batches:
                ranks = np.full((batch.num_rows, d), np.nan)
                lists = batch.column(1)
                row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten()
                i = flat.field("i").to_numpy()
                ranks[row, i] = flat.field("rank").to_numpy() - np.array([middle.get(k, 0.0) for k in range(d)])[i]
                total = [a + b for a, b in zip(total, sums(ranks, batch.column(0).to_numpy()))]
            yield packed(total)

        parts = rows.select("w", "r").mapInArrow(gather, schema)
    name = lambda k: F.element_at(F.array(*[F.lit(c) for c in columns]), F.col(k) + 1)
    one = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "xx", "yy", "xy")])
    out = one.select(name("i").alias("a"), name("j").alias("b"), F.col("n").cast("bigint").alias("n"), assoc.correlation(*[F.col(c) for c in ("n", "sx", "sy", "xx", "yy", "xy")]).alias("rho"))
    found = out.collect()  # a row a pair
    nums.unpersist()
    return spark.createDataFrame(found, out.schema)


def banded(r: Column) -> Column:
    """The band of a coefficient for display: by size .05/.2/.4/.6/.8, with its sign."""
    size = F.abs(r)
    band = F.when(size < 0.05, 0).when(size < 0.2, 1).when(size < 0.4, 2).when(size < 0.6, 3).when(size < 0.8, 4).otherwise(5)
    return F.when(r < 0, -band).otherwise(band)


def proxies(sensitive: list[str], categorical: DataFrame, numeric: DataFrame, least_v: float = 0.3, least_r: float = 0.4) -> DataFrame:
    """(col, other, metric, value, n), strongest first: measured pairs that touch a sensitive column. categorical: categorical_pairs(); numeric: strong_pairs()."""
    one = categorical.where(F.col("v") >= least_v).select("a", "b", F.lit("V").alias("metric"), F.col("v").alias("value"), "n")
    two = numeric.where(F.abs("r") >= least_r).select("a", "b", F.lit("r").alias("metric"), F.abs("r").alias("value"), "n")
    both = one.unionByName(two)
    sides = both.select(F.col("a").alias("col"), F.col("b").alias("other"), "metric", "value", "n").unionByName(both.select(F.col("b").alias("col"), F.col("a").alias("other"), "metric", "value", "n"))
    return sides.where(F.col("col").isin(*sensitive)).orderBy("col", F.desc("value"), "other")


def unmeasured_pairs(column: str, roles: dict[str, str]) -> int:
    """How many columns a column was not compared with, as one is numeric and the other categorical; a binary column is on both sides."""
    sides = {"numeric": {"n"}, "categorical": {"c"}, "binary": {"n", "c"}}
    own = sides.get(roles.get(column, ""), set())
    return sum(1 for c, r in roles.items() if c != column and r in sides and not sides[r] & own) if own else 0


def observations(associations: list, rows: int, target: str) -> list[tuple[str, str]]:
    """(kind, text) on the whole scan: no or weak signal, narrow coverage, signal without monotony."""
    out = []
    sizes = [r["abs_value"] for r in associations if r["abs_value"] is not None]
    if sizes and max(sizes) < 0.1:
        out.append(("no_signal", f"no feature shows a relationship with {target} of 0.1 or more"))
    elif sizes and max(sizes) < 0.3:
        out.append(("weak_signal", f"the strongest relationship with {target} is {max(sizes):.2f}"))
    out += [("narrow", f"{r['col']} was measured on {r['n']} of {rows} rows") for r in associations if rows and r["n"] / rows < 0.5]
    out += [("not_monotonic", f"{r['col']} tells about {target} in a way that is not monotonic (mutual information {r['mi']:.2f})") for r in associations if (r["mi"] or 0.0) >= 0.15 and (r["abs_value"] or 0.0) < 0.15]
    return out
