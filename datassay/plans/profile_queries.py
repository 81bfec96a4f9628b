"""Registered queries: profiles, roles, quality, univariate statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cells import sql_cell, sql_key, sql_missing, sql_number, sql_trim
from ..operators import profile as P
from ..operators import stats as S
from ..registry import register, table

# Column kinds of the driver's tables, for oracles.
CUSTOMER = {"c_custkey": "bigint", "c_name": "text", "c_nationkey": "bigint", "c_acctbal": "double", "c_mktsegment": "text"}
ORDERS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "text", "o_totalprice": "double", "o_orderdate": "timestamp", "o_orderpriority": "text"}
PART = {"p_partkey": "bigint", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "bigint", "p_retailprice": "double"}
LINEITEM = {"l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double"}


def sql_counts(name: str, kinds: dict[str, str]) -> str:
    """The frequency table (col, raw, n, missing, num, key) as SQL."""
    each = " UNION ALL ".join(f"SELECT '{c}' AS col, {sql_cell(c, k)} AS raw FROM {name}" for c, k in kinds.items())
    return f"(SELECT col, raw, n, missing, CASE WHEN NOT missing THEN {sql_number('raw')} END AS num, CASE WHEN NOT missing THEN {sql_key('raw')} END AS key FROM (SELECT col, raw, count(*) AS n, {sql_missing('raw')} AS missing FROM ({each}) GROUP BY col, raw))"


def sql_profile(name: str, kinds: dict[str, str]) -> str:
    return f"""SELECT col, sum(n)::BIGINT AS rows, coalesce(sum(n) FILTER (NOT missing), 0)::BIGINT AS present, coalesce(sum(n) FILTER (missing), 0)::BIGINT AS missing,
        coalesce(sum(n) FILTER (num IS NOT NULL), 0)::BIGINT AS numeric, coalesce(bool_and(coalesce(num = floor(num), false)) FILTER (NOT missing), false) AS all_integers,
        coalesce(sum(length(raw) * n) FILTER (NOT missing) / nullif(sum(n) FILTER (NOT missing), 0), 0) AS avg_length,
        coalesce(coalesce(sum(n) FILTER (NOT missing AND contains(raw, ' ')), 0) / nullif(sum(n) FILTER (NOT missing), 0), 0) AS space_share,
        count(*) FILTER (NOT missing) AS distinct_raw, count(DISTINCT key) AS distinct_keys, min(num) AS lo, max(num) AS hi FROM {sql_counts(name, kinds)} GROUP BY col"""


def counts(spark, sf_dir, name, kinds):
    return P.value_counts(table(spark, sf_dir, name), list(kinds))


def shown(profile):
    return profile.select("col", "rows", "present", "missing", "numeric", "all_integers", F.round("avg_length", 6).alias("avg_length"), F.round("space_share", 6).alias("space_share"), "distinct_raw", F.col("distinct").alias("distinct_keys"), F.round("min", 6).alias("lo"), F.round("max", 6).alias("hi"))


PROFILE_SQL = "SELECT col, rows, present, missing, numeric, all_integers, round(avg_length, 6) AS avg_length, round(space_share, 6) AS space_share, distinct_raw, distinct_keys, round(lo, 6) AS lo, round(hi, 6) AS hi FROM ({})"


@register("column_profile", PROFILE_SQL.format(sql_profile("customer", CUSTOMER)))
def column_profile(spark, sf_dir):
    return shown(P.column_profile(counts(spark, sf_dir, "customer", CUSTOMER)))


@register("column_profile_orders", PROFILE_SQL.format(sql_profile("orders", ORDERS)))
def column_profile_orders(spark, sf_dir):
    return shown(P.column_profile(counts(spark, sf_dir, "orders", ORDERS)))


@register("missing_counts", f"SELECT col, coalesce(sum(n) FILTER (missing), 0)::BIGINT AS missing, sum(n)::BIGINT AS rows FROM {sql_counts('part', PART)} GROUP BY ROLLUP(col)")
def missing_counts(spark, sf_dir):
    c = counts(spark, sf_dir, "part", PART)
    return c.rollup("col").agg(F.sum(F.when(F.col("missing"), F.col("n")).otherwise(0)).alias("missing"), F.sum("n").alias("rows"))


@register("numeric_share", f"SELECT col, round(coalesce(sum(n) FILTER (num IS NOT NULL), 0) / sum(n), 6) AS share FROM {sql_counts('part', PART)} WHERE NOT missing GROUP BY col")
def numeric_share(spark, sf_dir):
    p = P.column_profile(counts(spark, sf_dir, "part", PART)).where("present > 0")
    return p.select("col", F.round(F.col("numeric") / F.col("present"), 6).alias("share"))


@register("level_freq", f"SELECT col, key, sum(n)::BIGINT AS n, min({sql_trim('raw')}) AS label FROM {sql_counts('orders', {k: ORDERS[k] for k in ('o_orderstatus', 'o_orderpriority')})} WHERE NOT missing GROUP BY col, key")
def level_freq(spark, sf_dir):
    c = P.value_counts(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])
    return P.levels(c).select("col", "key", "n", "label")


def sql_roles(name: str, kinds: dict[str, str], temporal: list[str], target: str = "") -> str:
    dates = ", ".join(f"'{t}'" for t in temporal) or "''"
    named = "regexp_matches(col, '(?i)(\\b|_)(id|uuid|key|index|ref)(\\b|_|$)')"
    return f"""SELECT col, CASE WHEN {named} AND distinct_raw / rows > 0.9 AND col <> '{target}' THEN 'identifier' WHEN present = 0 THEN 'categorical' WHEN col IN ({dates}) THEN 'temporal'
        WHEN distinct_keys = 2 THEN 'binary' WHEN {named} AND col <> '{target}' AND distinct_keys > 50 THEN 'identifier' WHEN {named} AND col <> '{target}' THEN 'categorical'
        WHEN numeric / present >= 0.8 AND all_integers AND distinct_keys <= 4 THEN 'categorical' WHEN numeric / present >= 0.8 THEN 'numeric'
        WHEN avg_length >= 40 AND space_share >= 0.5 AND distinct_keys > 50 THEN 'text' WHEN col <> '{target}' AND distinct_keys <= 20000 AND present > 10 AND distinct_keys / present > 0.95 THEN 'identifier'
        ELSE 'categorical' END AS role FROM ({sql_profile(name, kinds)})"""


@register("roles_cascade", sql_roles("orders", ORDERS, ["o_orderdate"], "o_orderpriority"))
def roles_cascade(spark, sf_dir):
    from ..operators.temporal import temporal_columns

    c = counts(spark, sf_dir, "orders", ORDERS)
    return P.roles(P.column_profile(c), temporal_columns(c), target="o_orderpriority").select("col", "role")


@register("roles_part", sql_roles("part", PART, []))
def roles_part(spark, sf_dir):
    return P.roles(P.column_profile(counts(spark, sf_dir, "part", PART))).select("col", "role")


FLAGS_SQL = """SELECT col, distinct_raw = 1 AS constant, role NOT IN ('identifier', 'temporal', 'text', 'numeric') AND present > 10 AND distinct_raw / present > 0.95 AS high_cardinality,
    numeric < present AND numeric / present > 0.8 AS mixed_numeric, coalesce(distinct_raw BETWEEN 5 AND 25 AND all_integers AND lo IN (0, 1) AND distinct_keys = hi - lo + 1, false) AS possible_code FROM ({}) JOIN ({}) USING (col)"""


@register("quality_flags", FLAGS_SQL.format(sql_profile("customer", CUSTOMER), sql_roles("customer", CUSTOMER, [])))
def quality_flags(spark, sf_dir):
    return P.quality_flags(P.roles(P.column_profile(counts(spark, sf_dir, "customer", CUSTOMER))))


@register("duplicate_rows", "SELECT sum(n)::BIGINT AS rows, count(*) AS distinct_rows, (sum(n) - count(*))::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_quantity, l_discount, l_tax, l_returnflag, l_linestatus)")
def duplicate_rows(spark, sf_dir):
    return P.duplicate_rows(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"])


@register(
    "quality_score",
    f"""WITH p AS (SELECT * FROM ({sql_profile('orders', ORDERS)}) JOIN ({sql_roles('orders', ORDERS, ['o_orderdate'])}) USING (col)), d AS (SELECT sum(n) AS rows, sum(n) - count(*) AS dup FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)),
    a AS (SELECT sum(missing) / sum(rows) * 100 AS mp, max(missing / rows * 100) AS worst, count(*) FILTER (missing / rows * 100 > 20) AS gappy, count(*) FILTER (distinct_raw = 1) AS constants, count(*) FILTER (role = 'identifier') AS ids FROM p)
    SELECT round(mp, 6) AS missing_pct, dup::BIGINT AS duplicates, constants, ids, greatest(0, 100 - floor(0.45 * (100 - greatest(0, 100 - 2 * mp - CASE WHEN worst > 20 THEN floor((worst - 20) / 80 * 30 + 0.5) ELSE 0 END - 5 * gappy)) + 0.5) - floor(0.25 * (100 - greatest(0, 100 - dup / rows * 100 * 50)) + 0.5) - floor(0.15 * (100 - greatest(0, 100 - 15 * constants)) + 0.5) - floor(0.15 * (100 - greatest(0, 100 - 3 * ids)) + 0.5))::INT AS score FROM a, d""",
)
def quality_score(spark, sf_dir):
    from ..operators.temporal import temporal_columns

    df = table(spark, sf_dir, "orders")
    c = P.value_counts(df, list(ORDERS))
    return P.quality_score(P.roles(P.column_profile(c), temporal_columns(c)), P.duplicate_rows(df)).withColumn("missing_pct", F.round("missing_pct", 6))


@register("class_balance", "WITH c AS (SELECT lower(o_orderpriority) AS label, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT *, floor(n / (SELECT sum(n) FROM c) * 1000 + 0.5) / 10 AS pct FROM c) SELECT label, n, pct, coalesce(max(pct) OVER () / nullif(min(pct) OVER (), 0), 'infinity') > 3 OR max(pct) OVER () > 80 AS imbalanced FROM p")
def class_balance(spark, sf_dir):
    return P.class_balance(P.value_counts(table(spark, sf_dir, "orders"), ["o_orderpriority"]), "o_orderpriority")


TOP = {"p_brand": "text", "p_type": "text", "p_size": "bigint"}


@register("top_levels", f"WITH l AS (SELECT col, key, sum(n)::BIGINT AS n FROM {sql_counts('part', TOP)} WHERE NOT missing GROUP BY 1, 2) SELECT * FROM (SELECT col, key, n, round(n / sum(n) OVER (PARTITION BY col), 6) AS share, row_number() OVER (PARTITION BY col ORDER BY n DESC, key) AS rank FROM l) WHERE rank <= 10")
def top_levels(spark, sf_dir):
    return P.top_levels(counts(spark, sf_dir, "part", TOP)).withColumn("share", F.round("share", 6))


def unpivoted(cols: dict[str, str], name: str) -> str:
    return "(" + " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS DOUBLE) AS x FROM {name} WHERE {c} IS NOT NULL" for c in cols) + ")"


def nums(spark, sf_dir, name, kinds):
    return S.numbers(counts(spark, sf_dir, name, kinds))


@register("stats_location", f"SELECT col, count(*) AS n, round(avg(x), 8) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS lo, max(x) AS hi FROM {unpivoted(LINEITEM, 'lineitem')} GROUP BY col")
def stats_location(spark, sf_dir):
    return S.moments(nums(spark, sf_dir, "lineitem", LINEITEM)).select("col", "n", F.round("mean", 8).alias("mean"), F.round("std", 6).alias("std"), F.col("min").alias("lo"), F.col("max").alias("hi"))


@register("stats_shape", f"SELECT col, round(skewness(x), 6) AS skew, round(kurtosis(x), 6) AS kurtosis FROM {unpivoted(LINEITEM, 'lineitem')} GROUP BY col")
def stats_shape(spark, sf_dir):
    return S.moments(nums(spark, sf_dir, "lineitem", LINEITEM)).select("col", F.round("skew", 6).alias("skew"), F.round("kurtosis", 6).alias("kurtosis"))


@register("stats_quantiles", f"SELECT col, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q3 FROM {unpivoted(LINEITEM, 'lineitem')} GROUP BY col")
def stats_quantiles(spark, sf_dir):
    q = S.quantiles(nums(spark, sf_dir, "lineitem", LINEITEM), {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return q.select("col", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")])


PRICES = {"o_totalprice": "double"}


@register("outlier_fences_tukey", f"WITH q AS (SELECT col, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, count(DISTINCT x) AS d FROM {unpivoted(LINEITEM, 'lineitem')} GROUP BY col) SELECT col, round(q1 - 1.5 * (q3 - q1), 6) AS fence_low, round(q3 + 1.5 * (q3 - q1), 6) AS fence_high, CASE WHEN d > 10 THEN count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) ELSE 0 END AS outliers FROM {unpivoted(LINEITEM, 'lineitem')} JOIN q USING (col) GROUP BY col, q1, q3, d")
def outlier_fences_tukey(spark, sf_dir):
    n = nums(spark, sf_dir, "lineitem", LINEITEM)
    f = S.fences(S.quantiles(n, {"q1": 0.25, "q3": 0.75}).withColumn("mc", F.lit(0.0)))
    return f.join(S.outliers(n, f), "col").select("col", F.round("fence_low", 6).alias("fence_low"), F.round("fence_high", 6).alias("fence_high"), "outliers")


MEDCOUPLE_SQL = """WITH v AS (SELECT c_acctbal AS x, row_number() OVER (ORDER BY c_acctbal) - 1 AS i, count(*) OVER () AS n FROM customer WHERE c_acctbal IS NOT NULL),
    w AS (SELECT * FROM v WHERE n <= 1500 OR i IN (SELECT floor(k * (n - 1) / 1499 + 0.5) FROM range(1500) t(k), (SELECT max(n) AS n FROM v))), m AS (SELECT median(x) AS m FROM w),
    z AS (SELECT x - m AS z FROM w, m), h AS (SELECT (u.z + l.z) / (u.z - l.z) AS h FROM z u JOIN z l ON u.z >= 0 AND l.z <= 0 AND u.z <> l.z) SELECT 'c_acctbal' AS col, round(median(h), 6) AS mc FROM h"""


@register("medcouple_small", MEDCOUPLE_SQL)
def medcouple_small(spark, sf_dir):
    return S.medcouple(nums(spark, sf_dir, "customer", {"c_acctbal": "double"})).select("col", F.round("mc", 6).alias("mc"))


@register("histogram10", f"WITH e AS (SELECT col, min(x) AS lo, max(x) AS hi FROM {unpivoted(LINEITEM, 'lineitem')} GROUP BY col) SELECT col, CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / ((hi - lo) / 10)), 9) END::INT AS bin, count(*) AS n FROM {unpivoted(LINEITEM, 'lineitem')} JOIN e USING (col) GROUP BY 1, 2")
def histogram10(spark, sf_dir):
    return S.histogram(nums(spark, sf_dir, "lineitem", LINEITEM)).select("col", "bin", "n")


def sql_statistics(name: str, kinds: dict[str, str]) -> str:
    """One row a column: moments, quartiles, medcouple of at most 1500 evenly spaced order statistics, fences, outliers."""
    return f"""WITH v AS (SELECT col, x, row_number() OVER (PARTITION BY col ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY col) AS n FROM {unpivoted(kinds, name)}),
    s AS (SELECT col, k, CASE WHEN n <= 1500 THEN k ELSE floor(k * (n - 1) / 1499.0 + 0.5) END AS i FROM (SELECT DISTINCT col, n FROM v), range(1500) t(k) WHERE k < n),
    w AS (SELECT s.col, s.k, v.x FROM s JOIN v ON v.col = s.col AND v.i = s.i), m AS (SELECT col, median(x) AS m FROM w GROUP BY col),
    z AS (SELECT w.col, x - m AS z, row_number() OVER (PARTITION BY w.col, x - m ORDER BY k) - 1 AS o, count(*) OVER (PARTITION BY w.col, x - m) AS ties FROM w JOIN m USING (col)),
    h AS (SELECT u.col, CASE WHEN u.z <> l.z THEN (u.z + l.z) / (u.z - l.z) ELSE sign(u.o + l.o - (u.ties - 1)) END AS h FROM z u JOIN z l ON u.col = l.col AND u.z >= 0 AND l.z <= 0),
    mc AS (SELECT col, median(h) AS mc FROM h GROUP BY col),
    q AS (SELECT col, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS std, skewness(x) AS skew, kurtosis(x) AS kurtosis, min(x) AS min, max(x) AS max, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3, count(DISTINCT x) AS d FROM v GROUP BY col),
    f AS (SELECT *, q1 - 1.5 * exp(CASE WHEN mc >= 0 THEN -4 ELSE -3 END * mc) * (q3 - q1) AS lo, q3 + 1.5 * exp(CASE WHEN mc >= 0 THEN 3 ELSE 4 END * mc) * (q3 - q1) AS hi FROM q JOIN mc USING (col))
    SELECT col, max(f.n) AS n, round(max(mean), 8) AS mean, round(max(std), 6) AS std, round(max(skew), 6) AS skew, round(max(kurtosis), 6) AS kurtosis, max(min) AS min, max(max) AS max, round(max(q1), 6) AS q1, round(max(median), 6) AS median, round(max(q3), 6) AS q3, round(max(mc), 6) AS mc,
    round(max(lo), 5) AS fence_low, round(max(hi), 5) AS fence_high, CASE WHEN max(d) > 10 THEN count(*) FILTER (x < lo OR x > hi) ELSE 0 END AS outliers, round(max(q3 - q1), 6) AS iqr, CASE WHEN abs(max(skew)) < 0.5 THEN 'Low' WHEN abs(max(skew)) <= 1 THEN 'Moderate' ELSE 'High' END AS skew_label FROM f JOIN v USING (col) GROUP BY col"""


@register("full_statistics", sql_statistics("lineitem", LINEITEM))
def full_statistics(spark, sf_dir):
    out = S.statistics(P.value_counts(table(spark, sf_dir, "lineitem"), list(LINEITEM)), most=S.MEDCOUPLE_SAMPLE)
    return out.select("col", "n", F.round("mean", 8).alias("mean"), *[F.round(c, 6).alias(c) for c in ("std", "skew", "kurtosis")], "min", "max", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "mc")], *[F.round(c, 5).alias(c) for c in ("fence_low", "fence_high")], "outliers", F.round("iqr", 6).alias("iqr"), "skew_label")
