"""Bitmaps that tell which rows a join can match, so that only those rows are shuffled.

A bitmap holds every key it was built from and may hold others: a row that it does not mark has no match. It has
``PER_KEY`` bits for each key, between ``LEAST`` and ``MOST`` bits in all; beyond that bound (32 MB) it marks more rows
than it must, which costs shuffle and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import trimmed

PER_KEY, LEAST, MOST = 16, 1 << 20, 1 << 28


def bits_for(n_keys: int) -> int:
    """Bits of a bitmap of so many keys: a power of two."""
    return min(MOST, max(LEAST, 1 << (PER_KEY * max(n_keys, 1) - 1).bit_length()))


def bit_of(cols: list[str], bits: int):
    return F.pmod(F.xxhash64(*cols), F.lit(bits))


def key_bits(keys: DataFrame, cols: list[str], n_keys: int | None = None, hashed: bool = False) -> np.ndarray:
    """The bitmap of the keys, built on the executors; sized by their number (counted here unless given).

    ``hashed``: the one column is a hash already, and its last bits are its place.
    """
    bits = bits_for(keys.count() if n_keys is None else n_keys)
    at = (F.pmod(F.col(cols[0]), F.lit(bits)) if hashed else bit_of(cols, bits)) + 1  # Spark's buckets and places start at value 1
    parts = keys.select(F.bitmap_bucket_number(at).alias("part"), F.bitmap_bit_position(at).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("map")).collect()
    size = 32768 // 8
    out = np.zeros(bits // 8, np.uint8)
    for r in parts:
        out[(r["part"] - 1) * size : r["part"] * size] = np.frombuffer(bytes(r["map"]), np.uint8)
    return out


def marked(bits: np.ndarray, at: pa.Array) -> np.ndarray:
    """Whether the bitmap has each of the bit numbers."""
    i = at.to_numpy(zero_copy_only=False)
    return (bits[i >> 3] >> (i & 7).astype(np.uint8)) & 1 == 1


def free_name(names: list[str], tag: str) -> str:
    """A column name that none of ``names`` clashes with, whatever the session's case sensitivity."""
    taken = {n.lower() for n in names}
    while tag.lower() in taken:
        tag += "_"
    return tag


def routed(rows: DataFrame, bits, cols: list[str], want: bool) -> DataFrame:
    """The rows that the broadcast bitmap marks (want), or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(marked(bits.value, batch.column(batch.num_columns - 1)) == want))

    place = free_name(rows.columns, "_bit")
    out = rows.withColumn(place, bit_of(cols, bits.value.size * 8))
    return out.mapInArrow(trimmed(run), out.schema).drop(place)


def chosen(rows: DataFrame, keys: DataFrame, cols: list[str], n_keys: int | None = None) -> DataFrame:
    """All rows that a join with keys on cols can match, and few others."""
    return routed(rows, rows.sparkSession.sparkContext.broadcast(key_bits(keys, cols, n_keys)), cols, True)


def marking(rows: DataFrame, keys: DataFrame, col: str):
    """rows with a last column, the place of ``col`` in a bitmap of keys, and a function that keeps a batch's rows that it marks.

    For readers of whole texts: they filter as they read, so that a text goes to one Python worker, once.
    """
    bits = rows.sparkSession.sparkContext.broadcast(key_bits(keys, [col]))
    out = rows.withColumn(free_name(rows.columns, "_bit"), bit_of([col], bits.value.size * 8))
    return out, lambda batch: batch.filter(pa.array(marked(bits.value, batch.column(batch.num_columns - 1))))


def without(rows: DataFrame, keys: DataFrame, cols: list[str]) -> DataFrame:
    """rows LEFT ANTI JOIN keys USING (cols), shuffling only rows that can match."""
    bits = rows.sparkSession.sparkContext.broadcast(key_bits(keys, cols))
    return routed(rows, bits, cols, False).unionByName(routed(rows, bits, cols, True).join(keys, cols, "left_anti"))
