"""Registered queries: date families, dirty values and rules, personal data, intake."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cells import sql_missing, sql_number, sql_trim
from ..operators import cleaning as C
from ..operators import profile as P
from ..operators import temporal as T
from ..registry import register, table
from .profile_queries import ORDERS, counts, sql_counts

DATES = f"SELECT col, CASE WHEN regexp_matches(raw, '^\\d{{4}}-\\d{{2}}-\\d{{2}}T') THEN 'iso' END AS family, sum(n)::BIGINT AS n FROM {sql_counts('orders', ORDERS)} WHERE NOT missing GROUP BY 1, 2"


@register("date_family_counts", DATES)
def date_family_counts(spark, sf_dir):
    return T.family_counts(counts(spark, sf_dir, "orders", ORDERS))


@register("date_parse", "SELECT o_orderkey, o_orderdate AS iso, date_trunc('day', o_orderdate) AS day_first FROM orders")
def date_parse(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.select("o_orderkey", T.parse_date(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz").alias("iso"), T.parse_date(F.date_format("o_orderdate", "dd/MM/yyyy"), day_first=True).cast("timestamp_ntz").alias("day_first"))


def priced(spark, sf_dir):
    """Prices written dirtily: a third with a currency sign, some in thousands, some with a sentinel."""
    k = F.col("p_partkey")
    plain = F.col("p_size").cast("string")
    cell = F.when(k % 7 == 0, F.concat(F.lit("$"), plain)).when(k % 5 == 0, F.concat(plain, F.lit(" kg"))).when(k % 11 == 0, F.lit("-999")).otherwise(plain)
    brand = F.when(k % 3 == 0, F.upper("p_brand")).when(k % 3 == 1, F.regexp_replace("p_brand", "#", "-")).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", cell.alias("weight"), brand.alias("brand"))


PRICED = "(SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '$' || p_size WHEN p_partkey % 5 = 0 THEN p_size || ' kg' WHEN p_partkey % 11 = 0 THEN '-999' ELSE p_size::VARCHAR END AS weight, CASE WHEN p_partkey % 3 = 0 THEN upper(p_brand) WHEN p_partkey % 3 = 1 THEN replace(p_brand, '#', '-') ELSE p_brand END AS brand FROM part)"


@register("affix_groups", f"SELECT 'weight' AS col, affix, count(*) AS n, place FROM (SELECT CASE WHEN weight LIKE '%kg' THEN 'kg' ELSE '$' END AS affix, CASE WHEN weight LIKE '%kg' THEN 'suffix' ELSE 'prefix' END AS place FROM {PRICED} WHERE weight LIKE '%kg' OR weight LIKE '$%') GROUP BY ALL")
def affix_groups(spark, sf_dir):
    return C.affixes(P.value_counts(priced(spark, sf_dir), ["weight"]))


@register("sentinel_candidates", f"SELECT 'weight' AS col, -999.0::DOUBLE AS value, count(*) AS n FROM {PRICED} WHERE weight = '-999'")
def sentinel_candidates(spark, sf_dir):
    return C.sentinels(P.value_counts(priced(spark, sf_dir), ["weight"]))


@register("collision_groups", f"WITH l AS (SELECT lower(brand) AS level, count(*) AS n FROM {PRICED} GROUP BY 1), c AS (SELECT 'brand' AS col, regexp_replace(level, '[^a-z0-9]', '', 'g') AS ckey, count(*) AS spellings, sum(n)::BIGINT AS n FROM l GROUP BY 2 HAVING count(*) > 1) SELECT col, ckey, spellings, n FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, ckey) AS i FROM c) WHERE i <= 10")
def collision_groups(spark, sf_dir):
    return C.collisions(P.value_counts(priced(spark, sf_dir), ["brand"]))


UNITS = {"col": "weight", "kind": "unit_map", "factors": {"kg": 1000, "$": 1}}
GONE = {"col": "weight", "kind": "treat_as_missing", "values": [-999]}
MERGE = {"col": "brand", "kind": "merge_levels", "to": {"BRAND#11": "Brand#11", "Brand-11": "Brand#11"}}


@register("apply_unit_map", f"SELECT p_partkey, CASE WHEN weight LIKE '%kg' THEN (replace(weight, ' kg', '')::BIGINT * 1000)::VARCHAR WHEN weight LIKE '$%' THEN weight[2:] ELSE weight END AS weight FROM {PRICED}")
def apply_unit_map(spark, sf_dir):
    return C.clean(priced(spark, sf_dir), [UNITS]).select("p_partkey", "weight")


@register("apply_missing", f"SELECT p_partkey, nullif(weight, '-999') AS weight FROM {PRICED}")
def apply_missing(spark, sf_dir):
    return C.clean(priced(spark, sf_dir), [GONE]).select("p_partkey", "weight")


@register("apply_merge", f"SELECT p_partkey, CASE WHEN lower(brand) IN ('brand#11', 'brand-11') THEN 'Brand#11' ELSE brand END AS brand FROM {PRICED}")
def apply_merge(spark, sf_dir):
    return C.clean(priced(spark, sf_dir), [MERGE]).select("p_partkey", "brand")


@register("rule_effects", f"SELECT 0 AS rule, 'weight' AS col, 'unit_map' AS kind, count(*) FILTER (weight LIKE '%kg' OR weight LIKE '$%') AS changed, 0::BIGINT AS missing_before, 0::BIGINT AS missing_after FROM {PRICED} UNION ALL SELECT 1, 'weight', 'treat_as_missing', count(*) FILTER (weight = '-999'), 0, count(*) FILTER (weight = '-999') FROM {PRICED}")
def rule_effects(spark, sf_dir):
    return C.rule_effects(priced(spark, sf_dir), [UNITS, GONE])


PROPOSED = [UNITS | {"factors": {"kg": 1000, "$": 1, "lb": 2}}, GONE | {"values": [-999, 12345678]}, MERGE | {"to": {**MERGE["to"], "Brand#12": "Brand#11"}}, {"col": "brand", "kind": "shout"}, {"col": "nowhere", "kind": "unit_map"}]
NUMBERED = "regexp_full_match({0}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)')"


def sql_rule(col: str, kind: str, new: str) -> str:
    """One rule's effects: what changes, shares of numbers, and levels."""
    number = lambda c: NUMBERED.format(c)
    level = lambda c: f"CASE WHEN {number(c)} THEN CAST(CAST({c} AS DOUBLE) AS VARCHAR) ELSE lower(trim({c})) END"
    return f"SELECT '{col}' AS col, '{kind}' AS kind, count(*) FILTER (old IS DISTINCT FROM new) AS changed, round(coalesce(avg({number('old')}::INT), 0), 6) AS numeric_before, round(coalesce(avg({number('new')}::INT), 0), 6) AS numeric_after, count(DISTINCT {level('old')}) AS levels_before, count(DISTINCT {level('new')}) AS levels_after FROM (SELECT {col} AS old, {new} AS new FROM {PRICED})"


REFUSED = {"affix 'lb' dropped": "weight", "12345678 does not occur": "weight", "merge of 'Brand#12' into 'Brand#11' dropped": "brand", "no rule kind 'shout'": "brand", "not a column of this table": "nowhere"}
VERIFIED = " UNION ALL ".join([
    sql_rule("weight", "unit_map", "CASE WHEN weight LIKE '%kg' THEN (replace(weight, ' kg', '')::BIGINT * 1000)::VARCHAR WHEN weight LIKE '$%' THEN weight[2:] ELSE weight END"),
    sql_rule("weight", "treat_as_missing", "nullif(weight, '-999')"),
    sql_rule("brand", "merge_levels", "CASE WHEN lower(brand) IN ('brand#11', 'brand-11') THEN 'Brand#11' ELSE brand END"),
    *["SELECT '{}', '{}', 0, 0, 0, 0, 0".format(c, reason.replace("'", "''")) for reason, c in REFUSED.items()],
])


@register("verified_rules", VERIFIED)
def verified_rules(spark, sf_dir):
    df = priced(spark, sf_dir)
    kept, withheld = C.verify_rules(df, PROPOSED, P.value_counts(df, ["weight", "brand"]))
    rows = [(r["col"], r["kind"], r["changed"], round(r["numeric_before"], 6), round(r["numeric_after"], 6), r["levels_before"], r["levels_after"]) for r in kept]
    rows += [(c, reason, 0, 0.0, 0.0, 0, 0) for c, reason in withheld]
    return spark.createDataFrame(rows, "col string, kind string, changed bigint, numeric_before double, numeric_after double, levels_before bigint, levels_after bigint")


@register("personal_kind", "SELECT CASE WHEN regexp_full_match(w, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}') THEN 'email' WHEN regexp_full_match(w, 'https?://[^\\s]+') THEN 'url' WHEN regexp_full_match(w, '(25[0-5]|2[0-4]\\d|1?\\d?\\d)(\\.(25[0-5]|2[0-4]\\d|1?\\d?\\d)){3}') THEN 'ip' END AS kind, count(*) AS n FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM documents) WHERE regexp_matches(w, '@|https?://|^\\d+\\.\\d+\\.\\d+\\.\\d+$') GROUP BY 1")
def personal_kind(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    found = words.where(F.col("w").rlike(r"@|https?://|^\d+\.\d+\.\d+\.\d+$"))
    return found.groupBy(C.personal_kind(F.col("w")).alias("kind")).agg(F.count("*").alias("n"))


@register("personal_mask", "SELECT doc_id, length(text) - length(replace(text, '@', '')) > 0 AS had, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}') AS masked FROM documents")
def personal_mask(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    return df.select("doc_id", F.contains("text", F.lit("@")).alias("had"), F.contains(C.mask_personal(F.col("text")), F.lit("[email]")).alias("masked"))


@register("masked_text")
def masked_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.mask_personal(F.col("text")).alias("text"))


@register("canonical_keys", f"SELECT p_partkey, {sql_missing('weight')} AS missing, {sql_number('weight')} AS num, lower({sql_trim('weight')}) AS trimmed FROM {PRICED}")
def canonical_keys(spark, sf_dir):
    from ..functions import cells

    w = F.col("weight")
    return priced(spark, sf_dir).select("p_partkey", cells.is_missing(w).alias("missing"), cells.number(w).alias("num"), F.lower(cells.trimmed(w)).alias("trimmed"))


@register("quota_usage", "SELECT user_id, date_trunc('day', ts) AS day, count(*) AS used FROM events GROUP BY 1, 2")
def quota_usage(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("used"))


@register("saved_report_retention", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def saved_report_retention(spark, sf_dir):
    from ..sources.reports import newest

    return newest(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id", 10)
