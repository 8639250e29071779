"""Blocks of sorted runs: greedy cutting, sizes, zone maps and lookups in them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entry_bytes() -> Column:
    """Two lengths of two bytes, key and value; a deletion's value is empty."""
    return (4 + F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))).cast("long")


def greedy_cut(sizes: np.ndarray, new: np.ndarray, limit: int, start: int, used: int) -> tuple[np.ndarray, int, int]:
    """Number of the block of each entry. new: entries that begin a group. A block ends with the entry that fills it."""
    out = np.empty(sizes.size, np.int64)
    for i in range(sizes.size):
        if new[i]:
            start, used = 0, 0
        out[i] = start
        used += int(sizes[i])
        if used >= limit:
            start, used = start + 1, 0
    return out, start, used


def greedy_groups(rows: DataFrame, size: Column, limit: int, group: tuple[str, ...], order: str, name: str) -> DataFrame:
    """rows with a number that grows by one after each entry that brings the sizes since the last to the limit.

    The cut depends on all entries before, so a group is cut by one task, as a stream of batches: state is two numbers,
    and a group may be longer than memory. Groups (a run's key ranges, a log's shards) are spread over tasks.
    """
    sized = rows.withColumn("_size", size.cast("long"))
    ordered = sized.repartition(*group).sortWithinPartitions(*group, order)
    names = sized.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block, used = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = list(zip(*(batch.column(names.index(c)).to_pylist() for c in group)))
            new = np.array([a != b for a, b in zip(own, [last, *own[:-1]])])
            ids, block, used = greedy_cut(batch.column(names.index("_size")).to_numpy(), new, limit, block, used)
            last = own[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids)], names=[*names[:-1], name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return ordered.mapInArrow(run, f"{fields}, `{name}` long")


def block_cut(rows: DataFrame, block_size: int, group: tuple[str, ...] = ("run",)) -> DataFrame:
    """rows with block_id: entries in key order, a block closed by the entry that brings it to block_size."""
    return greedy_groups(rows, entry_bytes(), block_size, group, "key", "block_id")


def encoded_block_bytes(blocks: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """Bytes of each block with its count and offsets."""
    return blocks.groupBy(*group, "block_id").agg((4 + 4 * F.count(F.lit(1)) + F.sum(entry_bytes())).alias("block_bytes"))


def zone_map(blocks: DataFrame, group: tuple[str, ...]) -> DataFrame:
    return blocks.groupBy(*group, "block_id").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count(F.lit(1)).alias("n_entries"), F.sum(entry_bytes()).alias("bytes"))


def index_bytes(zones: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """Bytes of a run's index: offset, size and both keys with their lengths for each block."""
    return zones.groupBy(*group).agg(F.sum(16 + F.octet_length("min_key") + F.octet_length("max_key")).alias("index_bytes"), F.count(F.lit(1)).alias("n_blocks"))


def nth_entry(blocks: DataFrame, i: int, group: tuple[str, ...]) -> DataFrame:
    """Entry i (from 0) of each block that has one."""
    place = F.row_number().over(Window.partitionBy(*group, "block_id").orderBy("key"))
    return blocks.withColumn("_n", place).where(F.col("_n") == i + 1).drop("_n")


def lower_bound(blocks: DataFrame, probes: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """For each probe (column probe) and block, the place of the first entry at or after it; the block's size if none.

    The zone map answers for blocks that lie wholly before or after a probe; entries are counted in the others only.
    """
    zones = zone_map(blocks, group).join(probes)
    cut = (F.col("min_key") < F.col("probe")) & (F.col("max_key") >= F.col("probe"))
    far = zones.where(~cut).select(*group, "block_id", "probe", F.when(F.col("max_key") < F.col("probe"), F.col("n_entries")).otherwise(F.lit(0)).cast("long").alias("place"))
    near = blocks.join(zones.where(cut).select(*group, "block_id", "probe"), [*group, "block_id"])
    return far.unionByName(near.groupBy(*group, "block_id", "probe").agg(F.count_if(F.col("key") < F.col("probe")).alias("place")))


def pruned(zones: DataFrame, key) -> DataFrame:
    """Blocks that may hold a key."""
    return zones.where((F.col("min_key") <= F.lit(key)) & (F.col("max_key") >= F.lit(key)))


def floor_blocks(zones: DataFrame, probes: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """For each probe and run the last block whose first key is not after it: one pass over both in key order.

    A run's first keys and the probes (each with every run) are sorted together; the last block so far is the answer.
    """
    asked = zones.select(*group).distinct().join(probes.distinct()).select(*group, F.col("probe").alias("at"), F.lit(None).cast("long").alias("block_id"), F.lit(True).alias("asked"))
    both = zones.select(*group, F.col("min_key").alias("at"), F.col("block_id").cast("long").alias("block_id"), F.lit(False).alias("asked")).unionByName(asked)
    last = F.last("block_id", ignorenulls=True).over(Window.partitionBy(*group).orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("block_id", last).where("asked AND block_id IS NOT NULL").select(*group, F.col("at").alias("probe"), "block_id")
