"""The newest row of each key: every read, flush and compaction is one of these."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.model import DELETE, PUT


def latest_per_key(rows: DataFrame, by: tuple[str, ...] = ("key",), order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """One row for each key, the newest by ``order``, deletions included.

    A partial aggregation on the map side keeps one row for each key and task, so a key with very many versions costs
    no more than others. ``order`` must be unique within a key.
    """
    rest = [c for c in rows.columns if c not in by]
    kept = F.max_by(F.struct(*rest), F.struct(*order) if len(order) > 1 else F.col(order[0])).alias("_r")
    return rows.groupBy(*by).agg(kept).select(*by, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*rows.columns)


def latest_op(rows: DataFrame) -> DataFrame:
    """(key, op, seq) of the newest row of each key: latest_per_key() without values.

    seq and op in one number (op is 0 or 1, seq below 2 ** 62) are a hash aggregation, which sorts nothing.
    """
    packed = rows.groupBy("key").agg(F.max(F.col("seq").cast("long") * 2 + F.col("op")).alias("packed"))
    return packed.select("key", (F.col("packed") % 2).cast(rows.schema["op"].dataType).alias("op"), F.shiftright("packed", 1).cast(rows.schema["seq"].dataType).alias("seq"))


def live(latest: DataFrame) -> DataFrame:
    """Without deletions. Only after the last reduction: a deletion has to mask older rows first."""
    return latest.where(F.col("op") == PUT).drop("op")


def tombstones(latest: DataFrame) -> DataFrame:
    return latest.where(F.col("op") == DELETE)


def as_of(rows: DataFrame, version: int | None) -> DataFrame:
    """The log up to a version. This filter has to stay below the reduction."""
    return rows if version is None else rows.where(F.col("seq") <= version)


def view(rows: DataFrame, version: int | None = None) -> DataFrame:
    """The state at a version: the newest value of each key that is not deleted then."""
    return live(latest_per_key(as_of(rows, version)))


def overlay(base: DataFrame, buffer: DataFrame) -> DataFrame:
    """base with the rows of a buffer above it. ``buffer`` has tx_seq instead of seq; its rows are newer than all of base."""
    older = base.withColumn("tx_seq", F.lit(-1).cast("int"))
    newer = buffer.withColumn("seq", F.lit(None).cast(base.schema["seq"].dataType))
    both = older.unionByName(newer.select(*older.columns))
    # nulls order first, so buffered rows compare by tx_seq alone
    return latest_per_key(both, order=("tx_seq", "seq")).drop("tx_seq")
