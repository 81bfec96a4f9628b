"""The folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """From spark.checkpoint.dir; a local one where it is unset and there are no other machines (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it names the folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="datassay-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")
