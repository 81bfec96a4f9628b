"""Raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.

1. quality: documents that the quality classifier rejects go.
2. near_duplicates: of each group of documents whose sets of five-word shingles are linked by a Jaccard
   similarity of 0.8 or more, the one with the smallest id stays.
3. secrets: spans that the secret scan finds are replaced by a mark.
4. mixing: sources are drawn to their target weights; a document drawn twice is two rows, one not drawn goes.
5. packing: one row for each piece of each document, with its sequence and place.

Every stage reads the columns of documents by name, so other columns, whatever they are called, go. Null or empty texts and null ids: the quality
stage judges them as texts without words, the duplicates stage keeps them, the secrets stage leaves them as they are, mixing draws
them with size 0, packing gives them the end token. Repeated rows are copies in the duplicates stage and rows of their own in all others; ties go to
the smallest id. Texts of any length are read whole. An empty table passes through empty.

The model of stage 1 and the labelled random field of stage 3 have no SQL, so ORACLE_SQL is None;
tests/llm/test_pipeline.py holds every stage against a plain version instead.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datassay.llm.common import shared_dir
from datassay.llm.jaccard import drop_near_duplicates
from datassay.llm.mixing import mix_sources
from datassay.llm.packing import pack_documents
from datassay.llm.quality import judge_quality
from datassay.llm.secrets import scan_secrets_in_place

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MARK = "[SECRET]"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge_quality(docs.select(COLUMNS), labels, keep_text=True).where("keep").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, that of the smallest id; decided by row, so another text under a copy's id stays."""
    return drop_near_duplicates(docs.select(COLUMNS), n=5, num=80, den=100)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = scan_secrets_in_place(docs.select(COLUMNS), MARK)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)).select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs.select(COLUMNS)).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixing),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
