"""Key functions, blocks and snapshots on literal fixtures."""

import numpy as np
from pyspark.sql import functions as F

from keytide.functions.keys import fnv1a, has_prefix
from keytide.model import Config
from keytide.operators import blocks, merge, resolve, snapshots, writes


def python_fnv(data: bytes) -> int:
    h = 2166136261
    for b in data:
        h = (h ^ b) * 16777619 % 2**32
    return h


def test_fnv1a_of_any_bytes(spark):
    keys = [b"", b"a", b"foobar", b"\x00\xff\x80", "é中".encode()]
    got = {bytes(r["key"]): r["h"] for r in spark.createDataFrame([(bytearray(k),) for k in keys], "key binary").select("key", fnv1a(F.col("key")).alias("h")).collect()}
    assert got == {k: python_fnv(k) for k in keys}


def test_prefix_of_binary_and_text_keys(spark):
    df = spark.createDataFrame([(bytearray(x), x.decode()) for x in (b"a", b"ab", b"b")], "k binary, s string")
    assert [r["s"] for r in df.where(has_prefix(F.col("k"), b"a")).collect()] == ["a", "ab"]
    assert [r["s"] for r in df.where(has_prefix(F.col("s"), "a")).collect()] == ["a", "ab"]


def test_lower_bound_and_greedy_cut(spark):
    rows = spark.createDataFrame([(0, x, "v") for x in ("cherry", "apple", "banana")], "run int, key string, value string")
    cut = blocks.block_cut(rows, 10**6)
    probes = spark.createDataFrame([(p,) for p in ("aaa", "apple", "avocado", "banana", "cherry", "zzz")], "probe string")
    got = {r["probe"]: r["place"] for r in blocks.lower_bound(cut, probes, ("run",)).collect()}
    assert got == {"aaa": 0, "apple": 0, "avocado": 1, "banana": 1, "cherry": 2, "zzz": 3}
    ids, block, used = blocks.greedy_cut(np.array([5, 5, 1, 20, 3]), np.array([True, False, False, False, True]), 10, 0, 0)
    assert ids.tolist() == [0, 0, 1, 1, 0] and (block, used) == (0, 3)
    assert blocks.block_cut(rows.limit(0), 10).count() == 0


def test_compaction_policy(spark):
    sizes = lambda rows: spark.createDataFrame(rows, "level int, n_runs long, bytes long")
    due = lambda rows: merge.needs_compaction(sizes(rows), Config()).first()["level"]
    assert due([(0, 4, 10), (1, 0, 0)]) is None
    assert due([(0, 5, 10), (1, 0, 0)]) == 0
    assert due([(0, 1, 10), (1, 1, 99), (2, 0, 0)]) == 0
    assert due([(0, 1, 10), (1, 1, 100), (2, 1, 900)]) == 1
    manifest = spark.createDataFrame([], "level int, bytes long")
    assert merge.total_size(manifest).first()["bytes"] == 0 and merge.levels(spark, manifest, 7).count() == 7


def test_snapshot_registry_when_empty(spark):
    none = spark.createDataFrame([], "version bigint, ts timestamp")
    assert snapshots.min_version(none).first()["version"] is None and snapshots.is_needed(none, 0).first()["needed"] is False


def test_a_commit_keeps_the_last_of_equal_keys(spark):
    rows = spark.createDataFrame([(0, 0, "k", "a"), (1, 1, "k", None), (2, 0, "k", "b"), (3, 0, "e", "")], "i int, op int, key string, value string")
    got = {r["key"]: (r["op"], r["value"]) for r in writes.one_commit(rows.withColumn("op", F.col("op").cast("tinyint")), "i").collect()}
    assert got == {"k": (0, "b"), "e": (1, None)}


def test_overlay_puts_the_buffer_above_everything(spark):
    base = spark.createDataFrame([(10, 0, "a", "1"), (99, 0, "b", "1")], "seq long, op int, key string, value string")
    buffer = spark.createDataFrame([(0, 0, "b", "2"), (1, 1, "b", None), (2, 0, "c", "3")], "tx_seq int, op int, key string, value string")
    assert {(r["key"], r["value"]) for r in resolve.live(resolve.overlay(base, buffer)).collect()} == {("a", "1"), ("c", "3")}
