"""Registered queries: preparation, ridge baseline, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prep as M
from ..operators import profile as P
from ..operators import score as R
from ..registry import register, table
from .profile_queries import ORDERS, sql_profile, sql_roles


@register("folds_stratified", "SELECT fold, o_orderstatus, count(*) AS n FROM (SELECT o_orderstatus, (row_number() OVER (ORDER BY o_orderstatus, o_orderkey) - 1) % 5 AS fold FROM orders) GROUP BY ALL")
def folds_stratified(spark, sf_dir):
    out = M.stratified_folds(table(spark, sf_dir, "orders"), "o_orderstatus", F.col("o_orderkey"))
    return out.groupBy("fold", "o_orderstatus").agg(F.count("*").alias("n"))


GREEDY = """WITH RECURSIVE g AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS i FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)),
    s AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS load, [0, 0, 0, 0, 0]::BIGINT[] AS taken UNION ALL
          SELECT g.i, list_transform(load, lambda x, k: x + CASE WHEN k = list_position(load, list_min(load)) THEN g.n ELSE 0 END), list_transform(taken, lambda x, k: x + CASE WHEN k = list_position(load, list_min(load)) THEN 1 ELSE 0 END) FROM s JOIN g ON g.i = s.i + 1)
    SELECT unnest(range(0, 5))::INT AS fold, unnest(load) AS rows, unnest(taken) AS groups FROM (SELECT * FROM s ORDER BY i DESC LIMIT 1)"""


@register("folds_grouped", GREEDY)
def folds_grouped(spark, sf_dir):
    out = M.grouped_folds(table(spark, sf_dir, "orders"), "o_custkey")
    return out.groupBy("o_custkey", "fold").agg(F.count("*").alias("n")).groupBy("fold").agg(F.sum("n").alias("rows"), F.count("*").alias("groups"))


@register("impute_fill", "WITH j AS (SELECT d.doc_id, n_chars, toxic FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT doc_id, coalesce(toxic::DOUBLE, (SELECT median(toxic) FROM j)) AS toxic, toxic IS NULL AS was_missing FROM j")
def impute_fill(spark, sf_dir):
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.col("toxic").cast("double").alias("toxic"))
    return M.impute(j, {"toxic": "median"}).select("doc_id", "toxic", F.col("toxic__missing").alias("was_missing"))


@register("onehot_levels", "SELECT o_orderkey, (o_orderpriority = '1-URGENT')::INT AS a, (o_orderpriority = '5-LOW')::INT AS b FROM orders")
def onehot_levels(spark, sf_dir):
    out = M.one_hot(table(spark, sf_dir, "orders"), "o_orderpriority")
    return out.select("o_orderkey", F.col("o_orderpriority=1-urgent").alias("a"), F.col("o_orderpriority=5-low").alias("b"))


RIDGE = """WITH v AS (SELECT l_quantity AS x1, l_discount AS x2, l_extendedprice AS y FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_extendedprice IS NOT NULL), m AS (SELECT count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, covar_pop(x1, x1) * count(*) + 1 AS a, covar_pop(x1, x2) * count(*) AS b, covar_pop(x2, x2) * count(*) + 1 AS d, covar_pop(x1, y) * count(*) AS p, covar_pop(x2, y) * count(*) AS q FROM v)
    SELECT term, round(value, 4) AS value FROM (SELECT 'l_quantity' AS term, (p * d - q * b) / (a * d - b * b) AS value FROM m UNION ALL SELECT 'l_discount', (a * q - b * p) / (a * d - b * b) FROM m UNION ALL SELECT '(intercept)', my - m1 * (p * d - q * b) / (a * d - b * b) - m2 * (a * q - b * p) / (a * d - b * b) FROM m)"""


@register("ridge_fit", RIDGE)
def ridge_fit(spark, sf_dir):
    out = M.ridge(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice", alpha=1.0)
    return out.select("term", F.round("value", 4).alias("value"))


@register("cv_baseline")
def cv_baseline(spark, sf_dir):
    return M.cross_validate(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")


HEALTH = f"""WITH p AS (SELECT * FROM ({sql_profile('orders', ORDERS)}) JOIN ({sql_roles('orders', ORDERS, ['o_orderdate'])}) USING (col)), s AS (SELECT max(rows) AS n, count(*) AS k, count(*) FILTER (role = 'numeric') > 0 AS num, count(*) FILTER (role IN ('binary', 'categorical')) > 0 AS cat FROM p)
    SELECT round(0.45 * CASE WHEN n >= 1000 THEN 100 WHEN n >= 500 THEN 90 WHEN n >= 200 THEN 75 WHEN n >= 100 THEN 60 WHEN n >= 50 THEN 40 ELSE 20 END + 0.30 * CASE WHEN k BETWEEN 5 AND 50 THEN 100 WHEN k BETWEEN 3 AND 4 THEN 70 WHEN k BETWEEN 51 AND 100 THEN 85 WHEN k > 100 THEN 70 ELSE 30 END + 0.25 * CASE WHEN num AND cat THEN 100 WHEN num OR cat THEN 70 ELSE 40 END, 6) AS structure FROM s"""


@register("health_structure", HEALTH)
def health_structure(spark, sf_dir):
    from ..operators.temporal import temporal_columns

    c = P.value_counts(table(spark, sf_dir, "orders"), list(ORDERS))
    return R.structure_score(P.roles(P.column_profile(c), temporal_columns(c))).select(F.round("structure", 6).alias("structure"))


def orders_analysis(spark, sf_dir, baseline=True):
    from .analysis import profile

    return profile(table(spark, sf_dir, "orders"), target="o_orderstatus", baseline=baseline)


@register("health_score")
def health_score(spark, sf_dir):
    return orders_analysis(spark, sf_dir)["health"]


@register("readiness")
def readiness(spark, sf_dir):
    return orders_analysis(spark, sf_dir)["readiness"]


@register("recommendations")
def recommendations(spark, sf_dir):
    return orders_analysis(spark, sf_dir, baseline=False)["recommendations"]


@register("prep_plan")
def prep_plan(spark, sf_dir):
    return orders_analysis(spark, sf_dir, baseline=False)["plan"]


GUESS = f"""WITH p AS (SELECT p.col, role, rows, present, distinct_keys AS d, list_position([{', '.join(repr(c) for c in ORDERS)}], p.col) AS pos FROM ({sql_profile('orders', ORDERS)}) p JOIN ({sql_roles('orders', ORDERS, ['o_orderdate'])}) r ON r.col = p.col),
    u AS (SELECT *, pos = (SELECT max(pos) FROM p) AS last FROM p WHERE role IN ('binary', 'categorical', 'numeric') AND d >= 2 AND present / rows >= 0.5),
    c AS (SELECT 1 AS rule, pos AS o, col FROM u WHERE col IN ('target', 'label', 'class', 'outcome', 'churn', 'purchased', 'survived', 'default', 'fraud', 'status', 'result', 'y', 'output', 'price')
        UNION ALL SELECT 2, -pos, col FROM u WHERE list_has_any(string_split(col, '_'), ['target', 'label', 'outcome', 'churn', 'fraud', 'survived', 'purchased', 'price'])
        UNION ALL SELECT 3, 0, col FROM u WHERE last AND (role = 'binary' OR role = 'categorical' AND d <= 20) UNION ALL SELECT 5, -pos, col FROM u WHERE d <= greatest(20, ceil(0.05 * rows)) AND d / rows <= 0.05 UNION ALL SELECT 6, -pos, col FROM u WHERE role <> 'categorical' OR d <= 20)
    SELECT col AS target FROM c ORDER BY rule, o LIMIT 1"""


@register("target_guess", GUESS)
def target_guess(spark, sf_dir):
    from ..operators.temporal import temporal_columns

    c = P.value_counts(table(spark, sf_dir, "orders"), list(ORDERS))
    name = R.guess_target(P.roles(P.column_profile(c), temporal_columns(c)), c)
    return spark.createDataFrame([(name,)], "target string")
