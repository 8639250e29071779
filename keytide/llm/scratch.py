"""Intermediate tables in the folder that the cluster shares.

Every table that cuts lineage is written as Parquet below ``spark.checkpoint.dir``, so a lost executor loses
nothing. A cluster has to set that folder; a session with a local master gets a temporary one if it sets none.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes of an Arrow batch: whole texts are long, and Spark's default of 10,000 of them fills several times their
#: bytes, in the JVM's direct memory and in the worker. A row longer than that is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets BATCH_ROWS and BATCH_BYTES for the session, unless it has values of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if not spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after whose last batch the worker, which Spark keeps for later tasks, gives free memory back."""

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)

    return then


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a new local one where a local session has none."""
    small_batches(spark)
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="keytide-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the shared folder and read back with its own schema."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def smallest_hashes(df: DataFrame, hashed: Column, n: int, total: int) -> DataFrame:
    """The n rows with the smallest values of a 64-bit hash, of about ``total`` rows; no task sends more than its share.

    Rows above a cut-off that should hold a few more than n are left out before they are ordered; if it holds fewer, it
    moves up.
    """
    share = min(1.0, (n + 8 * n**0.5 + 64) / max(total, 1))
    while share < 1.0:
        some = df.where(hashed < F.lit(int(-(2**63) + share * 2**64)))
        if some.count() >= n:
            return some.orderBy(hashed, *df.columns).limit(n)
        share = min(1.0, 2 * share)
    return df.orderBy(hashed, *df.columns).limit(n)


def dropped(df: DataFrame) -> None:
    """Deletes the files behind a table of ``written()`` that no later plan reads."""
    path = getattr(df, "scratch_path", None)
    if path:
        delete(df.sparkSession, path)


def released(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nothing refers to any more; it does so when garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
