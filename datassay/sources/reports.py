"""The report store: rows of reports as Parquet, newest first, the oldest retired."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def newest(df: DataFrame, at: str, tie: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(at), F.desc(tie)).limit(k)


def save(spark: SparkSession, path: str, report_id: str, name: str, saved_at: str, payload: str, keep: int = 10) -> None:
    """Insert or replace a report, then keep the newest `keep`; a new version is written beside the old one and named by its number."""
    row = spark.createDataFrame([(report_id, name, saved_at, payload)], "id string, name string, saved_at string, result string")
    old = _versions(spark, path)
    rows = row if not old else spark.read.parquet(f"{path}/v{old[-1]}").where(F.col("id") != report_id).unionByName(row)
    newest(rows, "saved_at", "id", keep).write.parquet(f"{path}/v{(old[-1] if old else 0) + 1}")


def list_reports(spark: SparkSession, path: str) -> DataFrame:
    """Newest first, without their payload."""
    return spark.read.parquet(f"{path}/v{_versions(spark, path)[-1]}").drop("result").orderBy(F.desc("saved_at"))


def get_report(spark: SparkSession, path: str, report_id: str) -> DataFrame:
    return spark.read.parquet(f"{path}/v{_versions(spark, path)[-1]}").where(F.col("id") == report_id)


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    found = [s.getPath() for s in fs.listStatus(where)]
    done = [int(p.getName()[1:]) for p in found if p.getName()[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(done)
