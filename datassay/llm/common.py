"""What the training-data operators share: words, shared-folder tables and hashing.

Words everywhere are runs of bytes other than space and 0x09-0x0D, which is what
``bytes.split()`` cuts at; ``bytes.lower()`` lowers A-Z only. Both work on UTF-8 without
decoding, so a batch goes from Arrow to words without a Python ``str``.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a local one where it is unset and there are no other machines (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it names the folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="datassay-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str = "t", by: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder, in a folder for each value of `by`, and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.datassay_path = path
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished rounds: it does so when their plans are garbage, which an idle driver rarely collects."""
    gc.collect()
    spark._jvm.System.gc()


def discard(df: DataFrame, part: str = "") -> None:
    """Delete a table that materialize() wrote, or one of its folders, once nothing reads it any more."""
    path = getattr(df, "datassay_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{path}/{part}" if part else path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
        free_shuffles(df.sparkSession)


def tidied(work):
    """work, a function of batches, that gives the memory it has freed back to the system at its end: a worker is kept for later tasks of other stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return run


def binary(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """(first column, second column as UTF-8) of each batch."""
    for batch in batches:
        yield batch.column(0).to_pylist(), binary(batch.column(1))


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns: others, whatever they are called, can't clash with ours."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def crc_mod(column: Column, mod: int) -> Column:
    """crc32 of a number's decimal text, modulo mod."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(mod)


def crc_mod_py(value: int, mod: int) -> int:
    return zlib.crc32(str(value).encode()) % mod


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def parts_for(rows: int, per: int, least: int = 1) -> int:
    """How many partitions hold rows at per rows each."""
    return max(least, -(-rows // per))


def spread(df: DataFrame) -> DataFrame:
    """At least two tasks a core for CPU-bound maps, where a small input came in fewer splits."""
    want = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want // 2 else df.repartition(want)
