"""The registered training-data queries: thin, whole-table uses of the operators, under their contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


#: Words of a text, as the contracts cut them.
WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
SUBSTRING_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
     p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS b FROM d WHERE len(w) >= 20),
     win AS (SELECT doc_id, b, md5(array_to_string(w[b : b + 19], ' ')) AS k FROM p),
     again AS (SELECT doc_id, b FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, b) AS r FROM win) WHERE r > 1),
     gone AS (SELECT DISTINCT doc_id, b + j AS i FROM again, (SELECT unnest(range(0, 20)) AS j)),
     each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
     kept AS (SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY e.i) AS t FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
PHRASES_SQL = """
WITH low AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     piece AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM low),
     words AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM piece),
     grams AS (SELECT lang, 1 AS k, unnest(w) AS phrase FROM words
               UNION ALL SELECT lang, 2, array_to_string(w[i : i + 1], ' ') FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM words)
               UNION ALL SELECT lang, 3, array_to_string(w[i : i + 2], ' ') FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
     f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY 1, 2, 3),
     total AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY 1),
     cand AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
     cut AS (SELECT c.lang, c.k, c.phrase, c.a, j, array_to_string(w[1 : j], ' ') AS x, array_to_string(w[j + 1 : c.k], ' ') AS y FROM cand c, (VALUES (1), (2)) AS v(j) WHERE j < c.k),
     scored AS (SELECT c.lang, c.k, c.phrase, c.a, j, fx.n AS l, fy.n AS r, CAST((1000000::HUGEINT * c.a * c.a) // (fx.n::HUGEINT * fy.n) AS BIGINT) AS score
                FROM cut c JOIN f fx ON fx.lang = c.lang AND fx.phrase = c.x JOIN f fy ON fy.lang = c.lang AND fy.phrase = c.y),
     low_cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM scored) WHERE o = 1),
     inside AS (SELECT lang, sub, max(a) AS most FROM (SELECT lang, a, array_to_string(w[1 : 2], ' ') AS sub FROM cand WHERE k = 3 UNION ALL SELECT lang, a, array_to_string(w[2 : 3], ' ') FROM cand WHERE k = 3) GROUP BY 1, 2),
     kept AS (SELECT s.* FROM low_cut s LEFT JOIN inside i ON s.k = 2 AND i.lang = s.lang AND i.sub = s.phrase WHERE most IS NULL OR 100 * most < 50 * s.a),
     ranked AS (SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(t.n AS BIGINT) AS n, score FROM ranked JOIN total t USING (lang) WHERE rank <= 2000
"""
NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     pair AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
     pos AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS k FROM pair WHERE same) WHERE k <= 5),
     neg AS (SELECT p.anchor_id, p.positive_id, n.other AS negative_id, p.positive_score, n.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other) AS INT) AS rank
             FROM pos p JOIN pair n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 10
"""

#: Components by reach: every id starts at itself and takes the ids of what it links with.
NEARDUP_SQL = """
WITH RECURSIVE u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
     link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
     reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links, least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id,
       vec_id <= coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id) AS kept FROM embeddings
"""
JACCARD_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 3], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
     shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
     link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
     reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
     low AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id
"""

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_report

    return secret_report(table(spark, sf_dir, "documents"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, p_document, host_posterior, path_posterior, quality, keep; a document's source is its host, its language its path."""
    from .quality import judge_quality

    out = judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "p_document", "host_posterior", "path_posterior", "quality", "keep")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import conversation_digests, format_conversations

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return conversation_digests(format_conversations(turns.unionByName(more)))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op5_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import katz_scores

    return katz_scores(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixing_report

    return mixing_report(table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .substrings import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"), width=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(table(spark, sf_dir, "documents"), longest=3, least=10, top=2000)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .hard_negatives import hard_negatives

    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_secret_scan, op3_nn_descent, op4_embedding_near_dedup, op5_katz_lm, op6_best_fit_packing, op7_ngram_jaccard_join, op8_chat_format, op9_toxicity, op10_mix_sources, op11_substring_dedup, op12_phrase_mining, op13_hard_negatives, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op4_embedding_near_dedup": NEARDUP_SQL, "op7_ngram_jaccard_join": JACCARD_SQL, "op11_substring_dedup": SUBSTRING_SQL, "op12_phrase_mining": PHRASES_SQL, "op13_hard_negatives": NEGATIVES_SQL}
