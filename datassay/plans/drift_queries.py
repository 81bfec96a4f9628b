"""Registered queries: drift over time and between tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift as D
from ..registry import register, table

RN = "row_number() OVER (ORDER BY o_orderdate, o_orderkey)"
PLACED = f"(SELECT *, ceil(5 * rn / rows) - 1 AS period FROM (SELECT *, {RN} AS rn, count(*) OVER () AS rows FROM orders WHERE o_orderdate IS NOT NULL))"


def placed(spark, sf_dir):
    return D.periods(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey")


@register("time_periods", f"SELECT period::INT AS period, count(*) AS n, min(o_orderdate) AS start, max(o_orderdate) AS \"end\" FROM {PLACED} GROUP BY 1")
def time_periods(spark, sf_dir):
    return D.period_table(placed(spark, sf_dir), "o_orderdate")


@register("time_drift_rate", f"SELECT period::INT AS period, count(*) AS n, round(avg((o_orderstatus = 'F')::INT), 6) AS rate FROM {PLACED} GROUP BY 1")
def time_drift_rate(spark, sf_dir):
    return D.class_drift(placed(spark, sf_dir), "o_orderstatus", "F").withColumn("rate", F.round("rate", 6))


@register("time_drift_mean", f"WITH p AS (SELECT avg(o_totalprice) AS m FROM {PLACED} GROUP BY period) SELECT round(max(m) - min(m), 4) AS spread, round((SELECT stddev_samp(o_totalprice) FROM {PLACED}), 4) AS sd, round((max(m) - min(m)) / (SELECT stddev_samp(o_totalprice) FROM {PLACED}), 6) AS spread_sd FROM p")
def time_drift_mean(spark, sf_dir):
    return D.mean_drift(placed(spark, sf_dir), "o_totalprice").select(F.round("spread", 4).alias("spread"), F.round("sd", 4).alias("sd"), F.round("spread_sd", 6).alias("spread_sd"))


@register("late_columns", f"WITH p AS (SELECT *, CASE WHEN rn > rows / 2 THEN o_orderpriority END AS promo FROM {PLACED}) SELECT 'promo' AS col, round(avg((promo IS NULL)::INT) FILTER (rn <= floor(rows / 5)), 6) AS early, round(avg((promo IS NULL)::INT) FILTER (rn > rows - floor(rows / 5)), 6) AS late, avg((promo IS NULL)::INT) FILTER (rn <= floor(rows / 5)) >= 0.9 AND avg((promo IS NULL)::INT) FILTER (rn > rows - floor(rows / 5)) <= 0.5 AS is_late FROM p")
def late_columns(spark, sf_dir):
    p = placed(spark, sf_dir).withColumn("promo", F.when(F.col("rn") > F.col("rows") / 2, F.col("o_orderpriority")))
    return D.late_columns(p, ["promo"]).select("col", F.round("early", 6).alias("early"), F.round("late", 6).alias("late"), "is_late")


@register("future_rows", "SELECT count(*) FILTER (o_orderdate > TIMESTAMP '1998-01-01' + INTERVAL 1 DAY) AS future FROM orders")
def future_rows(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count_if(F.col("o_orderdate") > F.lit("1998-01-02").cast("timestamp")).alias("future"))


@register("time_cutoff", f"SELECT o_orderdate AS cutoff FROM {PLACED} WHERE rn = floor(0.8 * (rows - 1)) + 1")
def time_cutoff(spark, sf_dir):
    return D.time_cutoff(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey")


def halves(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.where(F.col("o_orderkey") % 2 == 0), df.where(F.col("o_orderkey") % 2 == 1)


TRAIN, TEST = "(SELECT * FROM orders WHERE o_orderkey % 2 = 0)", "(SELECT * FROM orders WHERE o_orderkey % 2 = 1)"


@register("row_overlap", f"SELECT count(*) AS test_rows, count(*) FILTER ((o_orderstatus, o_orderpriority, date_trunc('day', o_orderdate)) IN (SELECT (o_orderstatus, o_orderpriority, date_trunc('day', o_orderdate)) FROM {TRAIN})) AS copied FROM {TEST}")
def row_overlap(spark, sf_dir):
    a, b = (x.withColumn("day", F.date_trunc("day", "o_orderdate")) for x in halves(spark, sf_dir))
    return D.row_overlap(a, b, ["o_orderstatus", "o_orderpriority", "day"])


@register("entity_overlap", f"WITH t AS (SELECT o_custkey AS k, count(*) AS m FROM {TEST} GROUP BY 1) SELECT sum(m)::BIGINT AS test_rows, (sum(m) FILTER (k IN (SELECT o_custkey FROM {TRAIN})))::BIGINT AS shared_rows, count(*) AS test_values, count(*) FILTER (k IN (SELECT o_custkey FROM {TRAIN})) AS shared_values FROM t")
def entity_overlap(spark, sf_dir):
    return D.entity_overlap(*halves(spark, sf_dir), "o_custkey")


@register("unseen_levels", f"SELECT o_custkey::VARCHAR AS k, count(*) AS m FROM {TEST} WHERE o_custkey NOT IN (SELECT o_custkey FROM {TRAIN}) GROUP BY 1")
def unseen_levels(spark, sf_dir):
    return D.unseen_levels(*halves(spark, sf_dir), "o_custkey")


PSI = "SELECT round(greatest(raw - greatest(bins - 1, 0) * (1 / n + 1 / m), 0), 6) AS psi, round(raw, 6) AS psi_raw, bins FROM (SELECT sum((greatest(a / m, 1e-4) - greatest(e / n, 1e-4)) * ln(greatest(a / m, 1e-4) / greatest(e / n, 1e-4))) AS raw, count(*) AS bins, max(n) AS n, max(m) AS m FROM (SELECT e, a, sum(e) OVER () AS n, sum(a) OVER () AS m FROM ({})) WHERE e > 0 OR a > 0)"
EDGES = f"(SELECT DISTINCT x AS edge FROM (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM {TRAIN}) WHERE i IN (floor(0.1 * (n - 1)), floor(0.2 * (n - 1)), floor(3 / 10 * (n - 1)), floor(0.4 * (n - 1)), floor(0.5 * (n - 1)), floor(0.6 * (n - 1)), floor(0.7 * (n - 1)), floor(0.8 * (n - 1)), floor(0.9 * (n - 1))))"


@register("psi_numeric", "WITH v AS (" + f"SELECT o_totalprice AS x, 1 AS e, 0 AS a FROM {TRAIN} UNION ALL SELECT o_totalprice, 0, 1 FROM {TEST}), b AS (SELECT (SELECT count(*) FROM {EDGES} WHERE edge < x) AS bin, e, a FROM v) " + PSI.format("SELECT bin, sum(e) AS e, sum(a) AS a FROM b GROUP BY bin"))
def psi_numeric(spark, sf_dir):
    return D.psi(D.numeric_bins(*halves(spark, sf_dir), "o_totalprice")).select(F.round("psi", 6).alias("psi"), F.round("psi_raw", 6).alias("psi_raw"), "bins")


LEVELS = f"SELECT coalesce(t.k, u.k) AS k, coalesce(e, 0) AS e, coalesce(a, 0) AS a FROM (SELECT o_custkey::VARCHAR AS k, count(*) AS e FROM {TRAIN} GROUP BY 1) t FULL JOIN (SELECT o_custkey::VARCHAR AS k, count(*) AS a FROM {TEST} GROUP BY 1) u ON t.k = u.k"


@register("psi_categorical", f"WITH l AS (SELECT *, row_number() OVER (ORDER BY e DESC, k) AS i FROM ({LEVELS})) " + PSI.format("SELECT CASE WHEN e > 0 AND i <= 20 THEN k WHEN e > 0 THEN 'other' ELSE 'unseen' END AS bin, sum(e) AS e, sum(a) AS a FROM l GROUP BY 1"))
def psi_categorical(spark, sf_dir):
    return D.psi(D.level_bins(*halves(spark, sf_dir), "o_custkey")).select(F.round("psi", 6).alias("psi"), F.round("psi_raw", 6).alias("psi_raw"), "bins")


@register("ks_two_sample", f"WITH v AS (SELECT o_totalprice AS x, 1 AS a, 0 AS b FROM {TRAIN} UNION ALL SELECT o_totalprice, 0, 1 FROM {TEST}), g AS (SELECT x, sum(a) AS a, sum(b) AS b FROM v GROUP BY x), c AS (SELECT sum(a) OVER w / (SELECT sum(a) FROM g) - sum(b) OVER w / (SELECT sum(b) FROM g) AS gap FROM g WINDOW w AS (ORDER BY x)) SELECT round(max(abs(gap)), 8) AS d, (SELECT sum(a) FROM g)::BIGINT AS n, (SELECT sum(b) FROM g)::BIGINT AS m FROM c")
def ks_two_sample(spark, sf_dir):
    return D.ks_two_sample(*halves(spark, sf_dir), "o_totalprice").select(F.round("d", 8).alias("d"), "n", "m")


@register("missing_shift", "WITH j AS (SELECT d.doc_id, d.lang, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)), s AS (SELECT avg((toxic IS NULL)::INT) FILTER (doc_id % 2 = 0) * 100 AS train, avg((toxic IS NULL)::INT) FILTER (doc_id % 2 = 1) * 100 AS test FROM j) SELECT 'toxic' AS col, round(train, 6) AS train, round(test, 6) AS test, abs(train - test) >= 10 AS shift FROM s")
def missing_shift(spark, sf_dir):
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    out = D.missing_shift(j.where("doc_id % 2 = 0"), j.where("doc_id % 2 = 1"), ["toxic"])
    return out.select("col", F.round("train", 6).alias("train"), F.round("test", 6).alias("test"), "shift")
