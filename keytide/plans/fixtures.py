"""Driver tables as op logs. Keys and values are STRING here, which compares by UTF-8 bytes as BINARY does."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or a local one in a local session."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="keytide-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def padded(number: Column) -> Column:
    return F.lpad(number.cast("string"), 10, "0")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with many versions of few keys: a row for each event, errors delete their user."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), (F.col("event_type") == "error").cast("int").alias("op"),
        F.format_string("user:%05d", "user_id").alias("key"), F.col("props").alias("value"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of puts of unique keys."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.lit(0).alias("op"), padded(F.col("o_orderkey")).alias("key"), F.col("o_orderpriority").alias("value"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.lit(0).alias("op"), F.col("url").alias("key"), F.col("html").alias("value"))


def lineitem(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple[str, ...]]:
    """Overwriting puts, and the columns that order them: all of the table's, as its key is not unique."""
    t = table(spark, sf_dir, "lineitem")
    order = tuple(t.columns)
    key = F.concat(padded(F.col("l_orderkey")), F.lit("/"), F.col("l_linenumber").cast("string"))
    return t.withColumns({"op": F.lit(0), "key": key, "value": F.concat_ws(",", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")}), order


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log in about ten runs by seq."""
    log = events(spark, sf_dir)
    stride = log.agg(F.greatest(F.lit(1), F.expr("count(*) div 10")).alias("stride"))
    return log.join(F.broadcast(stride)).withColumn("run", F.expr("seq div stride")).drop("stride")


def customer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of which about a tenth are orders at every scale: twice the customers' numbers plus an offset."""
    c = table(spark, sf_dir, "customer")
    return c.select(padded(F.col("c_custkey") * 20).alias("key"))
