"""The registry of snapshots: rows (version, ts) of versions that readers still need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def released(snapshots: DataFrame, version: int) -> DataFrame:
    """Without all entries of a version."""
    return snapshots.where(F.col("version") != version)


def min_version(snapshots: DataFrame) -> DataFrame:
    """The oldest version in use; null if none is."""
    return snapshots.agg(F.min("version").alias("version"))


def is_needed(snapshots: DataFrame, version: int) -> DataFrame:
    """Whether some snapshot is at this version or a later one."""
    return snapshots.agg(F.coalesce(F.max("version") >= version, F.lit(False)).alias("needed"))
