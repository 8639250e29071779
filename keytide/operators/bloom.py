"""Bloom filters as tables of set bits: one number of bits everywhere, so no key is ever missed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytide.functions.keys import U32, fnv1a


def parameters(n_keys: int, bits_per_key: int = 10) -> tuple[int, int]:
    """Bits and hash functions for a number of keys: 69 % of the bits per key, between 1 and 30."""
    m = max(1, n_keys) * bits_per_key
    return m, min(30, max(1, m * 69 // 100 // max(1, n_keys)))


def second_hash(key: Column) -> Column:
    """A 32-bit hash independent of FNV-1a, and odd, from the MD5 of the key."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long").bitwiseOR(F.lit(1))


def places(key: Column, m: int, k: int, independent: bool = True) -> Column:
    """The k bits of a key. Without ``independent`` both hashes are FNV-1a."""
    one = fnv1a(key)
    two = second_hash(key) if independent else one
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (one + i.cast("long") * two) % (U32 + 1) % m)


def build(keys: DataFrame, m: int, k: int, group: tuple[str, ...] = (), independent: bool = True) -> DataFrame:
    """(group, bit): the set bits."""
    return keys.select(*group, F.explode(places(F.col("key"), m, k, independent)).alias("bit")).distinct()


def probe(bits: DataFrame, keys: DataFrame, m: int, k: int, independent: bool = True) -> DataFrame:
    """(key, maybe): false only for keys that were not added."""
    wanted = keys.select("key").distinct().select("key", F.explode(places(F.col("key"), m, k, independent)).alias("bit"))
    hit = wanted.distinct().join(bits.withColumn("_set", F.lit(1)), "bit", "left")
    return hit.groupBy("key").agg(F.bool_and(F.col("_set").isNotNull()).alias("maybe"))
