"""Registered queries: identifiers, dates as text, engine rules, pairs, comparison, fitted preparation, usage and choices of rows."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import accounts as U
from ..operators import assoc as A
from ..operators import claims as Q
from ..operators import cleaning as C
from ..operators import compare as M
from ..operators import model as L
from ..operators import profile as P
from ..operators import relations as R
from ..operators import sampling as S
from ..operators import temporal as T
from ..operators import timechecks as W
from ..registry import register, table
from .association_queries import sql_chi2
from .drift_queries import TEST, TRAIN, halves
from .profile_queries import CUSTOMER, ORDERS, PART, counts, sql_counts, sql_profile
from .text_queries import PRICED, priced

HINT = "(id|uuid|key|index|ref|phone|tel|mobile|fax|zip|zipcode|postal|postcode|ssn|account|acct|ticket|isbn|ean|upc|imei|vin|serial|invoice|plate)"


def sql_identifiers(name: str, kinds: dict[str, str]) -> str:
    """The identifier rules over all values, as SQL."""
    return f"""WITH c AS (SELECT * FROM {sql_counts(name, kinds)} WHERE NOT missing), w AS (SELECT col, length(replace(raw, '-', '')) AS width, sum(n) AS n FROM c WHERE regexp_matches(raw, '^-?\\d+$') GROUP BY 1, 2), o AS (SELECT *, sum(n) OVER (PARTITION BY col ORDER BY width) AS upto, sum(n) OVER (PARTITION BY col) AS total, row_number() OVER (PARTITION BY col ORDER BY n DESC, width) AS i FROM w),
        d AS (SELECT col, max(width) FILTER (i = 1) AS modal, max(n / total) FILTER (i = 1) AS share, min(width) FILTER (upto > total // 2) AS median_width FROM o GROUP BY col),
        v AS (SELECT col, sum(n) AS m, count(*) AS d, coalesce(sum(n) FILTER (num IS NOT NULL), 0) AS numbers, coalesce(min(num) IN (0, 1) AND max(num) - min(num) + 1 = sum(n) FILTER (num IS NOT NULL) AND count(DISTINCT num) = sum(n) FILTER (num IS NOT NULL) AND bool_and(coalesce(num = floor(num), true)), false) AS step, bool_or(regexp_matches(raw, '^0\\d+$')) AS zero, bool_and(regexp_matches(raw, '^-?\\d+$')) AS integers FROM c GROUP BY col),
        s AS (SELECT p.col, distinct_raw / rows AS named_share, v.*, coalesce(modal >= 5 AND share >= 0.9, false) AS constant, coalesce(median_width, 0) AS median_width, d / m AS uniq, regexp_matches(p.col, '(?i)(\\b|_){HINT}(\\b|_|$)') AS hint FROM ({sql_profile(name, kinds)}) p LEFT JOIN v ON v.col = p.col LEFT JOIN d ON d.col = p.col)
        SELECT col, regexp_matches(col, '(?i)(\\b|_)(id|uuid|key|index|ref)(\\b|_|$)') AND named_share > 0.9 OR coalesce(step AND m > 10 AND uniq > 0.95 AND numbers / m > 0.95, false) OR coalesce(zero, false) OR coalesce(hint AND (constant OR uniq > 0.99), false) OR coalesce(uniq > 0.99 AND integers AND median_width >= 6 AND (hint OR constant), false) AS identifier FROM s"""


@register("identifier_rules", sql_identifiers("orders", ORDERS))
def identifier_rules(spark, sf_dir):
    c = counts(spark, sf_dir, "orders", ORDERS)
    return P.identifiers(P.column_profile(c), P.identifier_shapes(c))


@register("id_sequence_check", "SELECT 'p_partkey' AS col, min(p_partkey) IN (0, 1) AND max(p_partkey) - min(p_partkey) + 1 = count(p_partkey) AND count(DISTINCT p_partkey) = count(p_partkey) AND count(*) > 10 AS sequence FROM part")
def id_sequence_check(spark, sf_dir):
    return P.identifier_shapes(counts(spark, sf_dir, "part", {"p_partkey": "bigint"})).select("col", "sequence")


@register("duplicate_times", "SELECT sum(n)::BIGINT AS rows, count(*) AS distinct_rows, (sum(n) - count(*))::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM (SELECT ts + to_microseconds(event_id % 3) AS t, event_type FROM events) GROUP BY t, event_type)")
def duplicate_times(spark, sf_dir):
    """Rows that differ by microseconds are no duplicates."""
    df = table(spark, sf_dir, "events")
    t = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") % 3)
    return P.duplicate_rows(df.select(t.alias("t"), "event_type"))


TEXTS = ["2024-01-15", "2024-1-15", "2024-01-15T25:00", "Marketing 5 2024", "decor 7, 2020", "Jan 15 24", "15-Jan-2024", "2024/02/30", "31.12.99", "13/13/2024", "may 3, 2021", "2024-01-15 10:30:00+05:30", "99", "45/01/2024"]
FAMILIES = ["iso", None, None, None, None, "month", "month", "slash_ymd", "slash_dm", None, "month", "iso", None, None]
TIMES = ["2024-01-15", None, None, None, None, "2024-01-15", "2024-01-15", None, None, None, "2021-05-03", "2024-01-15 05:00:00", None, None]
CASES = lambda xs: "CASE p_partkey % 14 " + " ".join(f"WHEN {i} THEN " + ("NULL" if x is None else f"'{x}'") for i, x in enumerate(xs)) + " END"


@register("date_texts", f"SELECT p_partkey, {CASES(FAMILIES)} AS family, CAST({CASES(TIMES)} AS TIMESTAMP) AS at FROM part")
def date_texts(spark, sf_dir):
    text = F.element_at(F.array(*[F.lit(t) for t in TEXTS]), (F.col("p_partkey") % 14 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.family(text).alias("family"), T.parse_date(text).cast("timestamp_ntz").alias("at"))


ENDS = "(SELECT CASE p_partkey % 9 WHEN 0 THEN -99999 WHEN 1 THEN 99999 WHEN 2 THEN -9 WHEN 3 THEN 99 ELSE p_size END::DOUBLE AS x FROM part)"


@register("sentinel_values", f"WITH v AS (SELECT x, count(*) AS n FROM {ENDS} GROUP BY x) SELECT 'x' AS col, x AS value, n FROM v WHERE x IN (-99999, -9999, -999, -99, 999, 9999, 99999) AND (x = (SELECT min(x) FROM v) OR x = (SELECT max(x) FROM v)) AND n >= 5 AND n / (SELECT sum(n) FROM v) >= 0.01")
def sentinel_values(spark, sf_dir):
    return C.sentinels(P.value_counts(ends(spark, sf_dir)))


def ends(spark, sf_dir):
    k = F.col("p_partkey") % 9
    return table(spark, sf_dir, "part").select(F.when(k == 0, -99999).when(k == 1, 99999).when(k == 2, -9).when(k == 3, 99).otherwise(F.col("p_size")).cast("double").alias("x"))


@register("far_sentinels", f"""WITH s(value) AS (VALUES (-99999.0::DOUBLE), (99999.0::DOUBLE)), r AS (SELECT value, x, row_number() OVER (PARTITION BY value ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY value) AS m FROM {ENDS}, s WHERE x <> value),
    q AS (SELECT value, min(x) AS lo, max(x) AS hi, max(x) FILTER (i = floor((m - 1) * 0.75)) - max(x) FILTER (i = floor((m - 1) * 0.25)) AS iqr FROM r GROUP BY value) SELECT 'x' AS col, value, (SELECT count(*) FROM {ENDS} WHERE x = value) AS n, CASE WHEN value < lo THEN lo - value WHEN value > hi THEN value - hi ELSE 0 END AS gap, iqr FROM q WHERE CASE WHEN value < lo THEN lo - value WHEN value > hi THEN value - hi ELSE 0 END > 3 * iqr""")
def far_sentinels(spark, sf_dir):
    return C.far_sentinels(P.value_counts(ends(spark, sf_dir)))


@register("engine_merges", f"WITH l AS (SELECT lower(brand) AS k, count(*) AS n, min(brand) AS label FROM {PRICED} GROUP BY 1), g AS (SELECT *, regexp_replace(k, '[^a-z0-9]', '', 'g') AS ckey FROM l), r AS (SELECT *, count(*) OVER (PARTITION BY ckey) AS spellings, sum(n) OVER (PARTITION BY ckey) AS total, row_number() OVER (PARTITION BY ckey ORDER BY n DESC, label) AS i FROM g), t AS (SELECT ckey, total FROM r WHERE i = 1 AND spellings > 1 ORDER BY total DESC, ckey LIMIT 10) SELECT ckey, spellings, k AS best FROM r WHERE i = 1 AND ckey IN (SELECT ckey FROM t)")
def engine_merges(spark, sf_dir):
    m = C.collision_members(P.value_counts(priced(spark, sf_dir), ["brand"]))
    return m.select("ckey", F.size("labels").cast("bigint").alias("spellings"), F.lower(F.col("labels")[0]["label"]).alias("best"))


LEVELS = ["l_returnflag", "l_linestatus", "l_discount", "l_tax", "l_quantity"]
LEVEL_PAIRS = [(a, b) for i, a in enumerate(LEVELS) for b in LEVELS[i + 1 :]]
PAIRS_SQL = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, n, r, c, floor(v * 100 + 0.5) / 100 AS v, CASE WHEN greatest(r, c) >= 3 * least(r, c) THEN CASE WHEN r > c THEN '{a}' ELSE '{b}' END END AS finer FROM (" + sql_chi2("lineitem", f"CAST({a} AS VARCHAR)", f"CAST({b} AS VARCHAR)") + ")" for a, b in LEVEL_PAIRS)


@register("categorical_pairs", PAIRS_SQL)
def categorical_pairs(spark, sf_dir):
    return R.categorical_pairs(table(spark, sf_dir, "lineitem"), LEVELS, least=0.0).select("a", "b", "n", "r", "c", "v", "finer")


@register("discretised_bins", "WITH e AS (SELECT DISTINCT x AS edge FROM (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem) WHERE i IN (1 * n // 8, 2 * n // 8, 3 * n // 8, 4 * n // 8, 5 * n // 8, 6 * n // 8, 7 * n // 8)) SELECT bin, count(*) AS n FROM (SELECT (SELECT count(*) FROM e WHERE edge <= l_extendedprice)::VARCHAR AS bin FROM lineitem) GROUP BY bin")
def discretised_bins(spark, sf_dir):
    df = A.discretised(table(spark, sf_dir, "lineitem").select("l_extendedprice"), "l_extendedprice", True)
    return df.groupBy(F.col("l_extendedprice").alias("bin")).agg(F.count("*").alias("n"))


@register("presence_signals", "WITH d AS (SELECT CASE WHEN toxic IS NULL THEN 'absent' ELSE 'present' END AS seen, source FROM documents LEFT JOIN labels USING (doc_id)) SELECT 'toxic' AS col, n, round(v, 6) AS v, round((SELECT avg((seen = 'present')::INT) FROM d WHERE source IS NOT NULL) * 100, 2) AS present_pct FROM (" + sql_chi2("d", "seen", "source") + ")")
def presence_signals(spark, sf_dir):
    df = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return R.presence_signals(df, ["toxic"], "source").select("col", "n", F.round("v", 6).alias("v"), F.round("present_pct", 2).alias("present_pct"))


@register("compare_classes", f"WITH t AS (SELECT lower(o_orderstatus) AS k, count(*) AS n FROM {TRAIN} GROUP BY 1), u AS (SELECT lower(o_orderstatus) AS k, count(*) AS n FROM {TEST} GROUP BY 1) SELECT coalesce(t.k, u.k) AS class, floor(coalesce(t.n, 0) / (SELECT sum(n) FROM t) * 1000 + 0.5) / 1000 AS train, floor(coalesce(u.n, 0) / (SELECT sum(n) FROM u) * 1000 + 0.5) / 1000 AS test FROM t FULL JOIN u ON t.k = u.k")
def compare_classes(spark, sf_dir):
    return M.class_shares(*halves(spark, sf_dir), "o_orderstatus")


@register("compare_entities", f"WITH t AS (SELECT count(*) AS n, count(DISTINCT o_custkey) AS d FROM {TRAIN}), u AS (SELECT count(*) AS m, count(*) FILTER (o_custkey IN (SELECT o_custkey FROM {TRAIN})) AS hit FROM {TEST}) SELECT 'o_custkey' AS col, d >= 0.95 * n AS per_row, m AS test_rows, hit AS in_train, round(hit / m, 6) AS share, CASE WHEN hit = 0 THEN NULL WHEN d >= 0.95 * n THEN 'blocker' WHEN hit / m >= 0.05 THEN 'fix' END AS level FROM t, u")
def compare_entities(spark, sf_dir):
    return M.entities(*halves(spark, sf_dir), "o_custkey").withColumn("share", F.round("share", 6))


@register("compare_dates", f"SELECT min(t.o_orderdate) AS train_from, max(t.o_orderdate) AS train_to, (SELECT min(o_orderdate) FROM {TEST}) AS test_from, (SELECT max(o_orderdate) FROM {TEST}) AS test_to, (SELECT min(o_orderdate) FROM {TEST}) >= max(t.o_orderdate) AS test_after_train, (SELECT min(o_orderdate) FROM {TEST}) <= max(t.o_orderdate) AND (SELECT max(o_orderdate) FROM {TEST}) >= min(t.o_orderdate) AS overlap FROM {TRAIN} t")
def compare_dates(spark, sf_dir):
    out = M.date_ranges(*halves(spark, sf_dir), "o_orderdate")
    return out.select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in ("train_from", "train_to", "test_from", "test_to")], "test_after_train", "overlap")


@register("compare_types", "SELECT 'p_size' AS col, round(avg((p_partkey % 3 = 0)::INT), 6) AS numeric_share FROM part HAVING avg((p_partkey % 3 = 0)::INT) < 0.8")
def compare_types(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" cm"))).alias("p_size"), F.col("p_retailprice"))
    return M.type_changes(df, ["p_size", "p_retailprice"]).withColumn("numeric_share", F.round("numeric_share", 6))


@register("time_split", "SELECT count(*) FILTER (o_orderdate < TIMESTAMP '1996-01-01') AS train, count(*) FILTER (o_orderdate >= TIMESTAMP '1996-01-01') AS test FROM orders")
def time_split(spark, sf_dir):
    a, b = W.time_split(table(spark, sf_dir, "orders"), "o_orderdate", "1996-01-01")
    return a.agg(F.count("*").alias("train")).crossJoin(b.agg(F.count("*").alias("test")))  # one row by one row


@register("target_drift", "WITH p AS (SELECT *, ceil(5 * rn / n) - 1 AS period FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)), r AS (SELECT lower(o_orderstatus) AS k FROM orders GROUP BY 1 ORDER BY count(*), 1 LIMIT 1), v AS (SELECT period, avg((lower(o_orderstatus) = (SELECT k FROM r))::INT) AS rate FROM p GROUP BY 1) SELECT 'rate' AS kind, (SELECT k FROM r) AS label, round(max(rate) - min(rate), 6) AS spread FROM v")
def target_drift(spark, sf_dir):
    rows = W.placed(table(spark, sf_dir, "orders"), "o_orderdate", False, "o_orderkey")
    return W.target_drift(rows, "o_orderstatus", "categorical")[1].select("kind", "label", F.round("spread", 6).alias("spread"))


PLAN = L.Plan("o_orderstatus", "classification", {"o_totalprice": ("mean", False), "o_custkey": ("median", True)}, {"o_orderpriority": False}, ["o_orderdate"])


@register("fitted_numbers", "SELECT 'o_totalprice' AS col, round(avg(o_totalprice), 6) AS fill, round(avg(o_totalprice), 6) AS mean, round(stddev_pop(o_totalprice), 6) AS scale FROM orders UNION ALL SELECT 'o_custkey', round(median(o_custkey), 6), round(avg(o_custkey), 6), round(stddev_pop(o_custkey), 6) FROM orders")
def fitted_numbers(spark, sf_dir):
    parts = L.fit(table(spark, sf_dir, "orders"), PLAN)
    rows = [(p["col"], round(p["fill"], 6), round(p["mean"], 6), round(p["scale"], 6)) for p in parts if p["kind"] == "numeric"]
    return spark.createDataFrame(rows, "col string, fill double, mean double, scale double")


@register("transformed_rows", "SELECT round(sum((o_totalprice - m) / s), 4) AS price, sum((o_orderpriority = '1-URGENT')::INT)::DOUBLE AS urgent, 0.0::DOUBLE AS missing, sum(CASE lower(o_orderstatus) WHEN 'f' THEN 0 WHEN 'o' THEN 1 ELSE 2 END)::DOUBLE AS y FROM (SELECT *, avg(o_totalprice) OVER () AS m, stddev_pop(o_totalprice) OVER () AS s FROM orders)")
def transformed_rows(spark, sf_dir):
    df, _ = L.encode_target(table(spark, sf_dir, "orders"), PLAN)
    x, _ = L.transform(df, L.fit(df, PLAN), ["datassay_y"])
    return x.agg((F.round(F.sum("o_totalprice"), 4) + 0.0).alias("price"), F.sum("`o_orderpriority=1-urgent`").alias("urgent"), F.sum("o_orderdate__missing").alias("missing"), F.sum("datassay_y").alias("y"))


# One-column scores in closed form: disjoint cells, ridge with penalty 1 and a free intercept; folds are given, by order.
CELLS = """WITH r AS (SELECT l_orderkey % 5 AS fold, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS c, l_extendedprice AS y, l_returnflag AS flag, l_discount::VARCHAR AS disc, l_quantity AS x FROM lineitem),
    t AS (SELECT f, r.* FROM r, (SELECT unnest(range(5)) AS f)),
    e AS (SELECT DISTINCT f, x AS edge FROM (SELECT f, x, row_number() OVER (PARTITION BY f ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY f) AS n FROM t WHERE fold <> f) WHERE i IN (SELECT j * n // 20 FROM range(1, 20) s(j))),
    b AS (SELECT f, x, count(edge) AS bin FROM (SELECT DISTINCT f, x FROM t) d LEFT JOIN e USING (f) WHERE edge <= x GROUP BY 1, 2),
    d AS (SELECT f, fold, c, y, 'l_returnflag' AS col, flag AS cell FROM t UNION ALL SELECT f, fold, c, y, 'l_discount', disc FROM t UNION ALL SELECT t.f, fold, c, y, 'l_quantity', coalesce(bin, 0)::VARCHAR FROM t LEFT JOIN b ON b.f = t.f AND b.x = t.x),"""
CLASS_SCORES = CELLS + """ k AS (SELECT f, c, (SELECT count(*) FROM t u WHERE u.f = t.f AND u.fold <> u.f) / (2.0 * count(*)) AS w FROM t WHERE fold <> f GROUP BY f, c),
    m AS (SELECT f, col, cell, sum(w) AS n, sum(w * (2 * c - 1)) AS s FROM d JOIN k USING (f, c) WHERE fold <> f GROUP BY ALL),
    i AS (SELECT f, col, (sum(s) - sum(s * n / (n + 1))) / (sum(n) - sum(n * n / (n + 1))) AS b0 FROM m GROUP BY ALL),
    p AS (SELECT d.f, d.col, d.c, avg((CASE WHEN b0 + coalesce((s - b0 * n) / (n + 1), 0) > 0 THEN 1 ELSE 0 END = d.c)::INT) AS hit FROM d JOIN i ON i.f = d.f AND i.col = d.col LEFT JOIN m ON m.f = d.f AND m.col = d.col AND m.cell = d.cell WHERE d.fold = d.f GROUP BY ALL)
    SELECT col, round(avg(score), 6) AS score FROM (SELECT f, col, avg(hit) AS score FROM p GROUP BY ALL) GROUP BY col"""
NUMBER_SCORES = CELLS + """ m AS (SELECT f, col, cell, count(*) AS n, sum(y) AS s FROM d WHERE fold <> f GROUP BY ALL),
    i AS (SELECT f, col, (sum(s) - sum(s * n / (n + 1.0))) / (sum(n) - sum(n * n / (n + 1.0))) AS b0 FROM m GROUP BY ALL),
    p AS (SELECT d.f, d.col, 1 - sum((y - b0 - coalesce((s - b0 * n) / (n + 1.0), 0)) ** 2) / (var_pop(y) * count(*)) AS score FROM d JOIN i ON i.f = d.f AND i.col = d.col LEFT JOIN m ON m.f = d.f AND m.col = d.col AND m.cell = d.cell WHERE d.fold = d.f GROUP BY ALL)
    SELECT col, round(avg(score), 6) AS score FROM p GROUP BY col"""


def column_scores(spark, sf_dir, goal, classes):
    from ..operators import baseline

    df = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_discount", "l_quantity", (F.col("l_orderkey") % 5).cast("int").alias("fold"), goal.cast("double").alias("datassay_y"))
    fit = baseline.fit_folds(df, {"l_quantity": ("mean", False)}, {"l_returnflag": False, "l_discount": False}, [], 5, True)
    _, alone = baseline.cross_validate(df, fit, classes, whole=False)
    return spark.createDataFrame([(c, round(sum(s for s, _ in own) / len(own), 6)) for c, own in alone.items()], "col string, score double")


@register("column_scores_class", CLASS_SCORES)
def column_scores_class(spark, sf_dir):
    return column_scores(spark, sf_dir, F.when(F.col("l_linestatus") == "O", 1).otherwise(0), 2)


@register("column_scores_number", NUMBER_SCORES)
def column_scores_number(spark, sf_dir):
    return column_scores(spark, sf_dir, F.col("l_extendedprice"), None)


# A class target by one number: the 2x2 system of a weighted ridge with scaled numbers, solved by hand.
BASELINE_SQL = """WITH r AS (SELECT l_orderkey % 5 AS fold, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS c, l_quantity AS a, l_discount AS b FROM lineitem), t AS (SELECT f, r.* FROM r, (SELECT unnest(range(5)) AS f)),
    s AS (SELECT f, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM t WHERE fold <> f GROUP BY f),
    k AS (SELECT f, c, count(*) AS m, sum(count(*)) OVER (PARTITION BY f) / (2.0 * count(*)) AS w FROM t WHERE fold <> f GROUP BY f, c),
    z AS (SELECT t.f, fold, t.c, (a - ma) / sa AS u, (b - mb) / sb AS v, w, 2.0 * t.c - 1 AS y FROM t JOIN s USING (f) JOIN k ON k.f = t.f AND k.c = t.c),
    g AS (SELECT f, sum(w) AS n, sum(w * u) / sum(w) AS mu, sum(w * v) / sum(w) AS mv, sum(w * y) / sum(w) AS my, sum(w * u * u) AS uu, sum(w * v * v) AS vv, sum(w * u * v) AS uv, sum(w * u * y) AS uy, sum(w * v * y) AS vy FROM z WHERE fold <> f GROUP BY f),
    q AS (SELECT *, uu - n * mu * mu + 1 AS p11, vv - n * mv * mv + 1 AS p22, uv - n * mu * mv AS p12, uy - n * mu * my AS q1, vy - n * mv * my AS q2 FROM g),
    w AS (SELECT *, (q1 * p22 - q2 * p12) / (p11 * p22 - p12 * p12) AS b1, (q2 * p11 - q1 * p12) / (p11 * p22 - p12 * p12) AS b2 FROM q),
    h AS (SELECT z.f, z.c, avg((CASE WHEN my + b1 * (u - mu) + b2 * (v - mv) > 0 THEN 1 ELSE 0 END = z.c)::INT) AS hit FROM z JOIN w ON w.f = z.f WHERE z.fold = z.f GROUP BY ALL)
    SELECT f::INT AS fold, round(avg(hit), 6) AS model, 0.5::DOUBLE AS baseline FROM h GROUP BY f"""


@register("classification_baseline", BASELINE_SQL)
def classification_baseline(spark, sf_dir):
    from ..operators import baseline

    df = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", (F.col("l_orderkey") % 5).cast("int").alias("fold"), F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0).alias("datassay_y"))
    fit = baseline.fit_folds(df, {"l_quantity": ("mean", False), "l_discount": ("median", False)}, {}, [], 5, False)
    scores, _ = baseline.cross_validate(df, fit, 2, per_column=False)
    return spark.createDataFrame([(f, round(m, 6), b) for f, (m, b) in enumerate(scores)], "fold int, model double, baseline double")


def analyses(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id"), F.concat(F.lit("analysis"), F.col("event_id").cast("string")).alias("id"), F.col("ts").cast("timestamp").alias("created_at"), (F.col("event_id") % 4).alias("requests"))


SQL_ANALYSES = "(SELECT user_id, 'analysis' || event_id AS id, ts AS created_at, event_id % 4 AS requests FROM events)"
NOW = datetime.datetime(2024, 1, 15, 12, 0, 0)


@register("usage_by_day", f"SELECT user_id, strftime(created_at, '%Y-%m-%d') AS period, count(*) AS used, greatest(3 - count(*), 0) AS free, strftime(max(created_at)::DATE + 1, '%Y-%m-%d') AS resets FROM {SQL_ANALYSES} WHERE requests > 0 OR created_at > TIMESTAMP '2024-01-15 11:50:00' GROUP BY 1, 2")
def usage_by_day(spark, sf_dir):
    return U.usage(analyses(spark, sf_dir), NOW, 3)


@register("quota_claims", f"WITH a AS (SELECT *, strftime(created_at, '%Y-%m-%d') AS period FROM {SQL_ANALYSES}), u AS (SELECT user_id, period, count(*) AS used FROM a WHERE id LIKE '%0' AND (requests > 0 OR created_at > TIMESTAMP '2024-01-15 11:50:00') GROUP BY 1, 2), r AS (SELECT a.user_id, a.id, row_number() OVER (PARTITION BY a.user_id, a.period ORDER BY created_at, id) + coalesce(used, 0) <= 2 AS granted FROM a LEFT JOIN u USING (user_id, period) WHERE id NOT LIKE '%0') SELECT user_id, id, granted FROM r UNION ALL SELECT user_id, id, true FROM a WHERE id LIKE '%0'")
def quota_claims(spark, sf_dir):
    """Those that end in 0 are known already; each user and day has room for two."""
    a = analyses(spark, sf_dir)
    return U.claims(a.where("id like '%0'"), a.select("user_id", "id", "created_at"), NOW, 2).select("user_id", "id", "granted")


@register("live_sessions", "SELECT c_custkey AS user_id, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate > TIMESTAMP '1997-01-01'")
def live_sessions(spark, sf_dir):
    tokens = table(spark, sf_dir, "orders").select(U.token_hash(F.col("o_orderkey").cast("string")).alias("token_hash"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("expires_at"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return U.sessions(tokens, users, datetime.datetime(1997, 1, 1)).select("user_id", "c_name")


@register("upserted_rows", "SELECT user_id, max(event_id) AS event_id FROM (SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) GROUP BY 1")
def upserted_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"))
    return U.upserted(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], "at").select("user_id", "event_id")


@register("column_facts", f"SELECT col, sum(n)::BIGINT AS present, coalesce(sum(n) FILTER (num IS NOT NULL), 0)::BIGINT AS numbers, least(count(*), 3) AS \"distinct\", bool_and(coalesce(num >= 0 AND num = floor(num), false)) AS whole FROM {sql_counts('customer', CUSTOMER)} WHERE NOT missing GROUP BY col")
def column_facts(spark, sf_dir):
    return Q.column_facts(table(spark, sf_dir, "customer"), list(CUSTOMER))


@register("count_outside", "SELECT count(*) FILTER (c_acctbal < 0 OR c_acctbal > 5000) AS outside FROM customer")
def count_outside(spark, sf_dir):
    return Q.outside(table(spark, sf_dir, "customer"), "c_acctbal", 0.0, 5000.0)


@register("scored_answers", "SELECT doc_id AS key, quality = toxic OR quality <> 0 AND abs(toxic - quality) <= 0.02 * quality AS hit FROM labels")
def scored_answers(spark, sf_dir):
    df = table(spark, sf_dir, "labels")
    return Q.score_answers(df.select(F.col("doc_id").alias("key"), F.col("quality").alias("value")), df.select(F.col("doc_id").alias("key"), F.col("toxic").alias("value"))).select("key", "hit")


@register("scattered_sample", "SELECT p_partkey FROM part WHERE p_partkey - 1 IN (SELECT (i * 2654435761) % (SELECT count(*) FROM part) FROM range(50) t(i))")
def scattered_sample(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    return S.sample_indices(df, F.col("p_partkey") - 1, df.count(), 50).select("p_partkey")


@register("even_sample", "WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS i, greatest(1, count(*) OVER () // 200) AS step FROM customer WHERE c_acctbal IS NOT NULL) SELECT c_custkey FROM r WHERE i % step = 0 AND i < step * 200")
def even_sample(spark, sf_dir):
    return S.even_sample(table(spark, sf_dir, "customer"), F.col("c_acctbal"), F.col("c_custkey")).select("c_custkey")


@register("first_seen_groups", "SELECT o_orderpriority, count(*) AS rows, min(o_orderkey) AS first FROM orders GROUP BY 1")
def first_seen_groups(spark, sf_dir):
    return S.first_seen(table(spark, sf_dir, "orders"), "o_orderpriority", F.col("o_orderkey"))


@register("banded_correlations", "WITH m AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem) SELECT CASE WHEN abs(r) < 0.05 THEN 0 WHEN abs(r) < 0.2 THEN 1 WHEN abs(r) < 0.4 THEN 2 WHEN abs(r) < 0.6 THEN 3 WHEN abs(r) < 0.8 THEN 4 ELSE 5 END * sign(r)::INT AS band FROM m")
def banded_correlations(spark, sf_dir):
    p = A.pearson_pairs(A.frame(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"]), ["l_quantity", "l_extendedprice"])
    return p.select(R.banded(F.col("r")).alias("band"))


@register("part_dictionary")
def part_dictionary(spark, sf_dir):
    from ..operators.stats import statistics
    from ..sources.exports import data_dictionary

    c = counts(spark, sf_dir, "part", PART)
    base = P.column_profile(c)
    roles = P.roles(base, T.temporal_columns(c), P.identifiers(base, P.identifier_shapes(c)))
    return data_dictionary(c, roles, statistics(c, ["p_size", "p_retailprice"]), P.quality_flags(roles), "p_brand")
