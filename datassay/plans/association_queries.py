"""Registered queries: associations between columns, conflicting labels, group findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.special import chi2_tail, correlation_p
from ..operators import assoc as A
from ..operators import groups as G
from ..registry import register, table

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PAIRS = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1 :]]
MATRIX = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, corr({a}, {b}) AS r FROM lineitem WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in PAIRS)


def lineitem(spark, sf_dir, categorical=()):
    return A.frame(table(spark, sf_dir, "lineitem"), NUMERIC, list(categorical))


@register("pearson_matrix", f"SELECT a, b, n, round(r, 6) AS r FROM ({MATRIX})")
def pearson_matrix(spark, sf_dir):
    return A.pearson_pairs(lineitem(spark, sf_dir), NUMERIC).withColumn("r", F.round("r", 6))


@register("pearson_pair", "SELECT 'p_size' AS a, 'p_retailprice' AS b, count(*) AS n, round(corr(p_size, p_retailprice), 6) AS r FROM part")
def pearson_pair(spark, sf_dir):
    wide = A.frame(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"])
    return A.pearson_pairs(wide, ["p_size", "p_retailprice"]).withColumn("r", F.round("r", 6))


@register("redundant_pairs", f"SELECT a, b, round(r, 6) AS r FROM ({MATRIX}) WHERE abs(r) >= 0.9")
def redundant_pairs(spark, sf_dir):
    return A.pearson_pairs(lineitem(spark, sf_dir), NUMERIC).where(F.abs("r") >= 0.9).select("a", "b", F.round("r", 6).alias("r"))


@register("clusters", f"WITH p AS (SELECT * FROM ({MATRIX}) WHERE abs(r) >= 0.05), e AS (SELECT a AS col FROM p UNION ALL SELECT b FROM p) SELECT col, count(*) AS partners FROM e GROUP BY col HAVING count(*) >= 2")
def clusters(spark, sf_dir):
    return A.clusters(A.pearson_pairs(lineitem(spark, sf_dir), NUMERIC), least=0.05)


@register("matrix_confidence", f"SELECT a, b, floor(r * 100 + 0.5) / 100 AS r2, CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.4 THEN 'moderate' ELSE 'weak' END AS strength FROM ({MATRIX})")
def matrix_confidence(spark, sf_dir):
    return A.matrix(lineitem(spark, sf_dir), NUMERIC).select("a", "b", "r2", "strength")


@register("correlation_pvalues")
def correlation_pvalues(spark, sf_dir):
    p = A.pearson_pairs(lineitem(spark, sf_dir), NUMERIC)
    value = correlation_p(F.col("r"), F.col("n"))
    return p.select("a", "b", "n", "r", value.alias("p"), A.confidence(value).alias("confidence"))


RANKS = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@register("spearman_pair", f"WITH r AS (SELECT {RANKS.format('p_size')} AS x, {RANKS.format('p_retailprice')} AS y FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL) SELECT 'p_size' AS a, 'p_retailprice' AS b, count(*) AS n, round(corr(x, y), 6) AS rho FROM r")
def spearman_pair(spark, sf_dir):
    wide = A.frame(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"])
    return A.spearman(wide, "p_size", "p_retailprice").withColumn("rho", F.round("rho", 6))


RANKED = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 END AS x{i}" for i, c in enumerate(NUMERIC))
SPEARMANS = f"WITH r AS (SELECT {RANKED} FROM lineitem) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER (x{NUMERIC.index(a)} IS NOT NULL AND x{NUMERIC.index(b)} IS NOT NULL) AS n, round(corr(x{NUMERIC.index(a)}, x{NUMERIC.index(b)}), 6) AS rho FROM r" for a, b in PAIRS)


@register("spearman_matrix", SPEARMANS)
def spearman_matrix(spark, sf_dir):
    from ..operators.relations import spearman_matrix as ranked

    return ranked(lineitem(spark, sf_dir), NUMERIC).withColumn("rho", F.round("rho", 6))


ETA = "SELECT count(*) AS n, count(DISTINCT g) AS k, CASE WHEN sum((x - m) * (x - m)) > 0 THEN (sum((gm - m) * (gm - m)) / sum((x - m) * (x - m))) ELSE 0 END AS eta2 FROM (SELECT g, x, avg(x) OVER () AS m, avg(x) OVER (PARTITION BY g) AS gm FROM ({}))"


@register("eta_raw", "SELECT 'l_extendedprice' AS value, 'l_returnflag' AS \"group\", n, k, round(sqrt(eta2), 6) AS eta FROM (" + ETA.format("SELECT lower(l_returnflag) AS g, l_extendedprice AS x FROM lineitem WHERE l_returnflag IS NOT NULL AND l_extendedprice IS NOT NULL") + ")")
def eta_raw(spark, sf_dir):
    return A.correlation_ratio(lineitem(spark, sf_dir, ["l_returnflag"]), "l_extendedprice", "l_returnflag").withColumn("eta", F.round("eta", 6))


@register("rank_eta", "SELECT 'p_retailprice' AS value, 'p_brand' AS \"group\", n, k, round((n - 1) * eta2, 5) AS h, round(sqrt(greatest(((n - 1) * eta2 - k + 1) / (n - k), 0)), 6) AS effect FROM (" + ETA.format(f"SELECT lower(p_brand) AS g, {RANKS.format('p_retailprice')} AS x FROM part WHERE p_brand IS NOT NULL AND p_retailprice IS NOT NULL") + ")")
def rank_eta(spark, sf_dir):
    wide = A.frame(table(spark, sf_dir, "part"), ["p_retailprice"], ["p_brand"])
    return A.rank_eta(wide, "p_retailprice", "p_brand").select("value", "group", "n", "k", F.round("h", 5).alias("h"), F.round("effect", 6).alias("effect"))


def sql_chi2(name: str, a: str, b: str) -> str:
    return f"""WITH t AS (SELECT lower({a}) AS x, lower({b}) AS y, count(*) AS o FROM {name} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2), m AS (SELECT o, sum(o) OVER (PARTITION BY x) * sum(o) OVER (PARTITION BY y) / sum(o) OVER () AS e, sum(o) OVER () AS n, x, y FROM t),
    s AS (SELECT max(n) AS n, count(DISTINCT x) AS r, count(DISTINCT y) AS c, sum((o - e) * (o - e) / e) + greatest(max(n) - sum(e), 0) AS chi2 FROM m) SELECT n::BIGINT AS n, r, c, chi2, sqrt(greatest(chi2 / n - (r - 1) * (c - 1) / (n - 1), 0) / least(r - (r - 1) * (r - 1) / (n - 1) - 1, c - (c - 1) * (c - 1) / (n - 1) - 1)) AS v FROM s"""


@register("cramers_v", "SELECT 'l_returnflag' AS a, 'l_linestatus' AS b, n, r, c, round(chi2, 4) AS chi2, round(v, 6) AS v FROM (" + sql_chi2("lineitem", "l_returnflag", "l_linestatus") + ")")
def cramers_v(spark, sf_dir):
    v = A.cramers_v(lineitem(spark, sf_dir, ["l_returnflag", "l_linestatus"]), "l_returnflag", "l_linestatus")
    return v.select("a", "b", "n", "r", "c", F.round("chi2", 4).alias("chi2"), F.round("v", 6).alias("v"))


@register("chi2_pvalue", "SELECT df, chi2, round(CASE WHEN df = 2 THEN exp(-chi2 / 2) WHEN df = 4 THEN exp(-chi2 / 2) * (1 + chi2 / 2) ELSE exp(-chi2 / 2) * (1 + chi2 / 2 + chi2 * chi2 / 8) END, 9) AS p FROM (SELECT unnest([2, 4, 6]) AS df), (SELECT DISTINCT p_size::DOUBLE AS chi2 FROM part)")
def chi2_pvalue(spark, sf_dir):
    grid = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("chi2")).distinct().select("chi2", F.explode(F.array(F.lit(2), F.lit(4), F.lit(6))).alias("df"))
    return grid.select("df", "chi2", F.round(chi2_tail(F.col("chi2"), F.col("df").cast("double")), 9).alias("p"))


@register("odds_ratio", """WITH c AS (SELECT count(*) FILTER (e AND o)::DOUBLE AS a, count(*) FILTER (e AND NOT o)::DOUBLE AS b, count(*) FILTER (NOT e AND o)::DOUBLE AS c, count(*) FILTER (NOT e AND NOT o)::DOUBLE AS d FROM (SELECT o_orderpriority = '1-URGENT' AS e, o_orderstatus = 'F' AS o FROM orders))
    SELECT (a + b + c + d)::BIGINT AS n, round(a * d / (b * c), 6) AS odds, round(exp(ln(a * d / (b * c)) - 1.96 * sqrt(1 / a + 1 / b + 1 / c + 1 / d)), 6) AS low, round(exp(ln(a * d / (b * c)) + 1.96 * sqrt(1 / a + 1 / b + 1 / c + 1 / d)), 6) AS high, round((a / (a + b)) / (c / (c + d)), 6) AS lift FROM c""")
def odds_ratio(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderpriority") == "1-URGENT").alias("exposed"), (F.col("o_orderstatus") == "F").alias("outcome"))
    return A.odds_ratio(rows).select("n", *[F.round(c, 6).alias(c) for c in ("odds", "low", "high", "lift")])


@register("mutual_information", """WITH t AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS o FROM lineitem GROUP BY 1, 2), n AS (SELECT sum(o) AS n FROM t), j AS (SELECT -sum(o / n * ln(o / n)) + (count(*) - 1) / (2 * max(n)) AS h FROM t, n),
    a AS (SELECT -sum(o / n * ln(o / n)) + (count(*) - 1) / (2 * max(n)) AS h FROM (SELECT x, sum(o) AS o FROM t GROUP BY x), n), b AS (SELECT -sum(o / n * ln(o / n)) + (count(*) - 1) / (2 * max(n)) AS h FROM (SELECT y, sum(o) AS o FROM t GROUP BY y), n)
    SELECT 'l_returnflag' AS a, 'l_linestatus' AS b, n.n::BIGINT AS n, round(greatest(a.h + b.h - j.h, 0), 6) AS mi, round(least(1, greatest(a.h + b.h - j.h, 0) / least(a.h, b.h)), 6) AS normalised FROM j, a, b, n""")
def mutual_information(spark, sf_dir):
    m = A.mutual_information(lineitem(spark, sf_dir, ["l_returnflag", "l_linestatus"]), "l_returnflag", "l_linestatus")
    return m.select("a", "b", "n", F.round("mi", 6).alias("mi"), F.round("normalised", 6).alias("normalised"))


@register("presence_signal", "WITH d AS (SELECT CASE WHEN toxic IS NULL THEN 'absent' ELSE 'present' END AS seen, source FROM documents LEFT JOIN labels USING (doc_id)) SELECT 'seen' AS a, 'source' AS b, n, r, c, round(chi2, 4) AS chi2, round(v, 6) AS v FROM (" + sql_chi2("d", "seen", "source") + ")")
def presence_signal(spark, sf_dir):
    df = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select(F.when(F.col("toxic").isNull(), "absent").otherwise("present").alias("seen"), "source")
    v = A.cramers_v(A.frame(df, [], ["seen", "source"]), "seen", "source")
    return v.select("a", "b", "n", "r", "c", F.round("chi2", 4).alias("chi2"), F.round("v", 6).alias("v"))


@register("target_scan")
def target_scan(spark, sf_dir):
    from ..operators.relations import target_associations

    df = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    roles = {"l_quantity": "numeric", "l_extendedprice": "numeric", "l_discount": "numeric", "l_tax": "numeric", "l_returnflag": "categorical", "l_linestatus": "binary"}
    return target_associations(df, roles, "l_linestatus")


FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linestatus"]


@register("label_conflicts", "WITH g AS (SELECT count(*) AS n, count(DISTINCT lower(l_returnflag)) AS t FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_quantity, l_discount, l_tax, l_linestatus) SELECT count(*) FILTER (t > 1) AS conflict_groups, coalesce(sum(n) FILTER (t > 1), 0)::BIGINT AS conflict_rows, count(*) AS groups, floor(count(*) / sum(n) * 1000 + 0.5) / 1000 AS distinct_share FROM g")
def label_conflicts(spark, sf_dir):
    return G.label_conflicts(table(spark, sf_dir, "lineitem"), FEATURES, "l_returnflag")


@register("id_only_repeats", "SELECT coalesce(sum(n - 1), 0)::BIGINT AS repeats FROM (SELECT count(DISTINCT (l_orderkey, l_linenumber)) AS n FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_quantity, l_discount, l_tax, l_linestatus, lower(l_returnflag))")
def id_only_repeats(spark, sf_dir):
    return G.id_only_repeats(table(spark, sf_dir, "lineitem"), FEATURES, ["l_orderkey", "l_linenumber"], "l_returnflag")


SAME_SQL = """WITH r AS (SELECT 'l_orderkey' AS col, l_orderkey::VARCHAR AS k, l_linestatus AS t FROM lineitem UNION ALL SELECT 'l_partkey', l_partkey::VARCHAR, l_linestatus FROM lineitem), c AS (SELECT col, k, t, count(*) AS n FROM r GROUP BY ALL), v AS (SELECT col, k, sum(n) AS n, max(n) AS top FROM c GROUP BY ALL),
    b AS (SELECT col, max(n) / sum(n) AS base FROM (SELECT col, t, sum(n) AS n FROM c GROUP BY ALL) GROUP BY col) SELECT col, (sum(n) FILTER (n > 1))::BIGINT AS repeated_rows, round(sum(top) FILTER (n > 1) / sum(n) FILTER (n > 1), 6) AS same, round(base, 6) AS base FROM v JOIN b USING (col) GROUP BY col, base HAVING count(*) > 50 AND sum(n) FILTER (n > 1) >= 20 AND base < 1"""


@register("same_target_values", SAME_SQL)
def same_target_values(spark, sf_dir):
    out = G.same_target_values(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"], "l_linestatus")
    return out.select("col", "repeated_rows", F.round("same", 6).alias("same"), F.round("base", 6).alias("base"))


@register("group_leak", "WITH c AS (SELECT o_custkey AS g, o_orderstatus AS t, count(*) AS n FROM orders GROUP BY 1, 2), v AS (SELECT g, sum(n) AS n, max(n) AS top FROM c GROUP BY g), b AS (SELECT max(n) / sum(n) AS base FROM (SELECT sum(n) AS n FROM c GROUP BY t)) SELECT sum(n)::BIGINT AS rows, (sum(n) FILTER (n > 1))::BIGINT AS repeated_rows, round(sum(top) FILTER (n > 1) / sum(n) FILTER (n > 1), 6) AS purity, round(max(base), 6) AS base FROM v, b")
def group_leak(spark, sf_dir):
    out = G.group_purity(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus")
    return out.select("rows", "repeated_rows", F.round("purity", 6).alias("purity"), F.round("base", 6).alias("base"))


@register("formula_check", "WITH v AS (SELECT l_extendedprice AS r, l_quantity * l_tax AS v FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL AND l_tax IS NOT NULL) SELECT count(*) AS rows, count(*) FILTER (abs(r - v) <= greatest(0.01, abs(r) * 0.01)) AS matches, round(count(*) FILTER (abs(r - v) <= greatest(0.01, abs(r) * 0.01)) / count(*), 6) AS share FROM v")
def formula_check(spark, sf_dir):
    return G.formula_check(table(spark, sf_dir, "lineitem"), "l_extendedprice", "product", ["l_quantity", "l_tax"]).withColumn("share", F.round("share", 6))


@register("formula_offsets", 'SELECT floor((n_nationkey - n_regionkey) * 100 + 0.5) / 100 AS "offset", count(*) AS n FROM nation GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5')
def formula_offsets(spark, sf_dir):
    return G.formula_offsets(table(spark, sf_dir, "nation"), "n_nationkey", ["n_regionkey"])


@register("kappa", "WITH t AS (SELECT quality AS x, 1 - toxic AS y, count(*) AS o FROM labels GROUP BY 1, 2), n AS (SELECT sum(o) AS n, sum(o) FILTER (x = y) AS d FROM t), e AS (SELECT sum(r.o * c.o) AS e FROM (SELECT x, sum(o) AS o FROM t GROUP BY x) r JOIN (SELECT y, sum(o) AS o FROM t GROUP BY y) c ON x = y) SELECT n::BIGINT AS n, round(d / n, 6) AS agree, round(e / (n * n), 6) AS expected, round((d / n - e / (n * n)) / (1 - e / (n * n)), 6) AS kappa FROM n, e")
def kappa(spark, sf_dir):
    out = G.kappa(table(spark, sf_dir, "labels").withColumn("other", 1 - F.col("toxic")), "quality", "other")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("agree", "expected", "kappa")])


@register("balanced_accuracy", "SELECT round(avg(hit), 6) AS balanced_accuracy FROM (SELECT quality, avg((quality = 1 - toxic)::INT) AS hit FROM labels GROUP BY quality)")
def balanced_accuracy(spark, sf_dir):
    out = G.balanced_accuracy(table(spark, sf_dir, "labels").withColumn("other", 1 - F.col("toxic")), "quality", "other")
    return out.select(F.round("balanced_accuracy", 6).alias("balanced_accuracy"))
