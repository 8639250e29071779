"""Functions of byte keys. Binary and UTF-8 string columns compare as unsigned bytes, the shorter prefix first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 32-bit FNV-1a.
FNV_BASIS, FNV_PRIME, U32 = 2166136261, 16777619, 4294967295


def prefix_end(prefix: bytes) -> bytes | None:
    """The smallest key after all keys with the prefix; None if there is none (empty, or 0xff only)."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def in_range(key: Column, start=None, end=None) -> Column:
    """start <= key < end; a bound that is None is open. The predicate is pushed to Parquet."""
    out = F.lit(True)
    if start is not None:
        out = key >= F.lit(start)
    if end is not None:
        out = (key < F.lit(end)) if start is None else out & (key < F.lit(end))
    return out


def has_prefix(key: Column, prefix) -> Column:
    if isinstance(prefix, str):
        return key.startswith(prefix)
    return in_range(key, prefix, prefix_end(prefix))


def fnv1a(key: Column) -> Column:
    """32-bit FNV-1a of the key's bytes, as a fold over its hexadecimal digits."""
    digits = F.hex(key.cast("binary"))
    n = F.octet_length(key)
    byte = lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(FNV_BASIS).cast("long"), lambda h, i: h.bitwiseXOR(byte(i)) * FNV_PRIME % (U32 + 1))
