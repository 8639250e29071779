"""Log rows for batches of puts and deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.model import DELETE, PUT, checked, normalised

from .resolve import latest_op, latest_per_key


def put_rows(pairs: DataFrame) -> DataFrame:
    return normalised(pairs.withColumn("op", F.lit(PUT).cast("tinyint")))


def delete_rows(keys: DataFrame, value_type: str = "binary") -> DataFrame:
    """Deletions are blind: no key needs to exist."""
    return keys.select("key", F.lit(DELETE).cast("tinyint").alias("op"), F.lit(None).cast(value_type).alias("value"))


def one_commit(rows: DataFrame, ordinal: str | None = None) -> DataFrame:
    """The rows (key, op, value) of one commit: of a key that comes several times the last by ``ordinal``.

    All rows of a commit get the same seq, its number: with one row for each key that stays unique within a key, needs
    no global numbering, and makes a commit visible as a whole. Without an ordinal the larger row wins.
    """
    rows = checked(normalised(rows))
    last = latest_per_key(rows, order=(ordinal,) if ordinal else ("op", "value"))
    return last.select("op", "key", "value")


def memtable_stats(rows: DataFrame, key_overhead: int = 8, entry_overhead: int = 16) -> DataFrame:
    """entries (deletions included), tombstones and bytes of an unflushed part: of all operations, so overwriting counts."""
    size = F.octet_length("key") + F.when(F.col("op") == PUT, F.octet_length("value") + entry_overhead).otherwise(F.lit(key_overhead))
    newest = latest_op(rows).agg(F.count(F.lit(1)).alias("entries"), F.sum((F.col("op") == DELETE).cast("long")).alias("tombstones"))
    return newest.join(rows.agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("operations")))


def record_bytes(rows: DataFrame) -> DataFrame:
    """Length of each row as a log record: total, op, key length, key, value length, value."""
    return rows.withColumn("record_bytes", 13 + F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)))
