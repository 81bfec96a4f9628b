"""Registered queries on intake: files that Spark writes from the given tables, read by the quote-aware scan."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.shared import shared_dir
from ..registry import register, table
from ..sources.delimited import read_many


def written(df, name: str) -> str:
    """A folder of delimited files of df's rows, every cell quoted."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return f"{path}/*.csv"


@register("intake_quoted", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(coalesce(text, '')) AS text_md5, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents")
def intake_quoted(spark, sf_dir):
    """Texts with line breaks, quotes and delimiters through files and back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    scan, _ = read_many(spark, written(docs, "intake"))
    cell = lambda i: F.get("cells", F.lit(i))
    return scan.rows().select(cell(0).alias("doc_id"), F.md5(cell(1).cast("binary")).alias("text_md5"), cell(2).alias("lang"), cell(3).alias("source"))


@register("intake_ragged", "SELECT count(*) AS rows, count(*) FILTER (o_orderkey % 3 = 0) AS ragged FROM orders")
def intake_ragged(spark, sf_dir):
    """Rows of which every third lacks a cell."""
    orders = table(spark, sf_dir, "orders")
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")))
    path = f"{shared_dir(spark)}/ragged-{uuid.uuid4().hex}"
    orders.select(line.alias("value")).write.text(path)
    # A file's width is its first row's, whatever that has, so what differs from three cells is told from the cells.
    scan, _ = read_many(spark, f"{path}/*.txt", delimiter=",", headerless=True)
    return scan.rows().agg(F.count("*").alias("rows"), F.count_if(F.size("cells") != 3).alias("ragged"))
