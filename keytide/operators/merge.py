"""Flush, ordered merge, level accounting and compaction as queries over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keytide.model import PUT, Config

from .blocks import greedy_groups
from .resolve import latest_per_key


def flush_run(rows: DataFrame, run: tuple[str, ...] = ()) -> DataFrame:
    """The newest row of each key of a part of the log, deletions kept: what a run holds."""
    return latest_per_key(rows, by=(*run, "key"))


def run_columns() -> list[Column]:
    """What the manifest holds of a run, as aggregates of its rows."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return [F.count(F.lit(1)).alias("n_rows"), F.sum((F.col("op") != PUT).cast("long")).alias("n_tombstones"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.sum(size).alias("bytes"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq")]


def run_stats(runs: DataFrame, run: str = "run") -> DataFrame:
    return runs.groupBy(run).agg(*run_columns())


def generations_by_stride(rows: DataFrame, stride: int) -> DataFrame:
    """The default flush policy: a generation every ``stride`` commits."""
    return rows.withColumn("generation", F.expr(f"seq div {int(stride)}"))


def generations_by_size(rows: DataFrame, max_bytes: int, shard: tuple[str, ...]) -> DataFrame:
    """rows with their generation: a shard's memtable is flushed after the operation that fills it; all operations count."""
    size = F.octet_length("key") + F.when(F.col("op") == PUT, F.octet_length("value") + 16).otherwise(F.lit(8))
    return greedy_groups(rows, size, max_bytes, shard, "seq", "generation")


def merge_sorted(parts: list[DataFrame]) -> DataFrame:
    """All rows of all runs in key order, newer first within a key, nothing resolved."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("key", F.desc("seq"))


def merge_resolved(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return latest_per_key(out)


def compacted(rows: DataFrame, drop_tombstones: bool) -> DataFrame:
    """The merged content of a compaction's input. Deletions may go only if no older run left out can hold the key."""
    newest = latest_per_key(rows)
    return newest.where(F.col("op") == PUT) if drop_tombstones else newest


def levels(spark: SparkSession, manifest: DataFrame, max_levels: int) -> DataFrame:
    """(level, n_runs, bytes) of every level, empty ones too; manifest has level and bytes."""
    spine = spark.range(max_levels).select(F.col("id").cast("int").alias("level"))
    got = manifest.groupBy("level").agg(F.count(F.lit(1)).alias("n_runs"), F.sum("bytes").alias("bytes"))
    return spine.join(F.broadcast(got), "level", "left").select("level", F.coalesce("n_runs", F.lit(0)).alias("n_runs"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def needs_compaction(sizes: DataFrame, config: Config = Config()) -> DataFrame:
    """(level): the level to compact, or null. Level 0 by its runs; else the first that is large against the next.

    ``sizes`` has one row for each of a few levels.
    """
    nxt = F.lead("bytes").over(Window.orderBy("level"))
    due = sizes.withColumn("next", nxt)
    by_count = (F.col("level") == 0) & (F.col("n_runs") > config.l0_compaction_threshold)
    by_size = (F.col("bytes") > 0) & (F.col("next") > 0) & (F.col("bytes") * config.level_ratio > F.col("next"))
    return due.agg(F.min(F.when(by_count | by_size, F.col("level"))).alias("level"))


def total_size(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
