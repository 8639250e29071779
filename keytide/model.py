"""Schemas, settings, errors and the write boundary of the key-value model.

The database is an append-only log of rows (seq, op, key, value): op 0 puts, op 1 deletes. Everything that is read is
the newest row of each key in some part of that log, without the deleted ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUT, DELETE = 0, 1
#: Keys and values are at most this long.
MAX_BYTES = 65_535

PAIR = "key binary, value binary"
LOG = "seq bigint, op tinyint, key binary, value binary"


class KeytideError(Exception):
    """Base of all errors."""


class StoreClosed(KeytideError):
    """A call on a closed store."""


class TxNotActive(KeytideError):
    """A call on a transaction that was committed or rolled back."""


class TxConflict(KeytideError):
    """A key that the transaction read was written after it began."""


class InvalidArgument(KeytideError):
    """An argument outside what is allowed, such as an oversize key."""


class Corrupted(KeytideError):
    """A manifest or run that cannot be read."""


class CommitConflict(KeytideError):
    """Another writer committed first."""


@dataclass(frozen=True)
class Config:
    """Settings. ``wal_sync`` is accepted and has no effect: the file system's commit decides."""

    memtable_max_size: int = 4 * 1024 * 1024
    block_size: int = 4096
    l0_compaction_threshold: int = 4
    max_levels: int = 7
    level_ratio: int = 10
    bloom_bits_per_key: int = 10
    run_file_bytes: int = 128 * 1024 * 1024
    #: Attempts at a commit against other writers; 1 tries once.
    commit_attempts: int = 5
    #: Age in seconds from which files that no recent manifest names may be removed; a write must not take longer.
    expire_grace: float = 24 * 3600.0
    wal_sync: str = "no_sync"

    def __post_init__(self):
        for name in ("memtable_max_size", "block_size", "l0_compaction_threshold", "max_levels", "level_ratio", "bloom_bits_per_key", "run_file_bytes", "commit_attempts"):
            if getattr(self, name) < 1:
                raise InvalidArgument(f"{name} must be at least 1")


def normal_op(op: Column, value: Column) -> Column:
    """An empty or missing value is a deletion."""
    return F.when(value.isNull() | (F.octet_length(value) == 0), F.lit(DELETE)).otherwise(op).cast("tinyint")


def normalised(rows: DataFrame) -> DataFrame:
    """Log rows as they are stored: empty puts become deletions, deletions carry no value."""
    out = rows.withColumn("op", normal_op(F.col("op"), F.col("value")))
    return out.withColumn("value", F.when(F.col("op") == PUT, F.col("value")))


def checked(rows: DataFrame) -> DataFrame:
    """rows, failing at run time on a null key or on keys and values above MAX_BYTES."""
    bad_key = F.col("key").isNull() | (F.octet_length("key") > MAX_BYTES)
    bad_value = F.coalesce(F.octet_length("value") > MAX_BYTES, F.lit(False))
    message = F.lit(f"InvalidArgument: a key is missing, or a key or value is longer than {MAX_BYTES} bytes")
    return rows.withColumn("key", F.when(bad_key | bad_value, F.raise_error(message).cast(rows.schema["key"].dataType)).otherwise(F.col("key")))
