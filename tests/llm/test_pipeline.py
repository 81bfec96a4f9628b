"""The pipeline's stages against plain versions of what they decide."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from datassay.llm import jaccard, secrets
from datassay.llm.quality import judge_quality

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        at[name] = docs
        if name != "packing":
            assert sorted(docs.columns) == sorted(columns)
    first = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in judge_quality(first, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r["keep"]}
    assert {r["doc_id"] for r in at["quality"].collect()} == kept
    groups = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_join(at["quality"], 5, 80, 100).collect()}
    assert sorted(r["doc_id"] for r in at["near_duplicates"].collect()) == sorted(i for i, c in groups.items() if i == c)
    assert len(groups) > len(set(groups.values()))
    scores = secrets.Scores(secrets.Crf.train())
    before = {r["doc_id"]: r["text"] for r in at["near_duplicates"].collect()}
    for r in at["secrets"].collect():
        assert r["text"] == secrets.blank(before[r["doc_id"]], secrets.spans(before[r["doc_id"]].encode(), scores)[1], corpus_pipeline.MARK) and r["n_chars"] == len(r["text"])
        assert not secrets.base_spans(r["text"].encode())
    drawn = Counter(r["doc_id"] for r in at["mixing"].collect())
    assert max(drawn.values()) <= 3 and set(drawn) <= set(before)
    from tokenizers import Tokenizer

    from datassay.llm.packing import default_tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    lengths = {r["doc_id"]: len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for r in at["secrets"].collect()}
    packed = Counter()
    for r in at["packing"].collect():
        packed[r["doc_id"]] += r["length"]
    assert packed == Counter({i: n * lengths[i] for i, n in drawn.items()})


def test_repeated_and_odd_rows(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta", "en", "s", 1), (1, "alpha beta gamma delta epsilon zeta", "en", "s", 1), (2, "alpha beta gamma delta epsilon zeta", "en", "s", 1), (None, None, None, None, None), (3, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted((r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()), key=str) == [1, 3, None]
    assert corpus_pipeline.secrets(spark, docs, SF).count() == 5
    assert corpus_pipeline.packing(spark, docs, SF).count() == 5
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def test_another_text_under_a_copys_id_stays(spark):
    t, u = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight"
    rows = [(2, t, "en", "s", 1), (5, t, "en", "s", 1), (5, u, "en", "s", 1), (5, u, "en", "s", 1), (7, u.upper(), "en", "s", 1), (8, "", "en", "s", 0), (8, "", "en", "s", 0), (9, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("k1", F.lit(0)).withColumn("stays", F.lit(True))
    kept = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()), key=str)
    assert kept == [(2, t), (5, u), (8, ""), (9, None)]


def test_clashing_columns_of_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).withColumns({c: F.lit("x") for c in ("keep", "quality", "size", "shard", "id", "label", "component_id", "sequence_id", "spans")})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() > 0, name
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS, name
