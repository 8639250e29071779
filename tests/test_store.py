"""The store on disk: recovery, masking across runs, versions, transactions and a model-based random test."""

import random

import pytest
from pyspark.sql import functions as F

from keytide.functions.keys import prefix_end
from keytide.model import CommitConflict, Config, Corrupted, InvalidArgument, StoreClosed, TxConflict, TxNotActive
from keytide.sources.manifest import Manifests
from keytide.sources.store import Store
from keytide.sources.transaction import Transaction
from keytide.streaming.ingest import ingest


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/db"


def state(store, *a, **b):
    return [(bytes(r["key"]), bytes(r["value"])) for r in store.scan(*a, **b).collect()]


def test_put_get_delete_and_recovery(spark, path):
    with Store.open_default(spark, path) as s:
        s.put("hello", "world")
        s.put_batch([("foo", "bar"), ("gone", "x"), ("foo", "baz")])
        s.delete("gone")
        s.delete("never there")
        assert s.get("hello") == b"world" and s.get("foo") == b"baz"
        assert s.get("gone") is None and s.get("missing") is None
        assert s.memtable_size() == 4 and s.run_count() == 0
    for call in (lambda: s.get("a"), lambda: s.put("a", "b"), lambda: s.delete("a"), lambda: s.put_batch([]), lambda: s.scan()):
        with pytest.raises(StoreClosed):
            call()
    assert s.memtable_size() == 0 and s.run_count() == 0
    s.close()
    again = Store.open(spark, path)
    assert state(again) == [(b"foo", b"baz"), (b"hello", b"world")]
    again.put("later", "1")
    assert state(Store.open(spark, path))[-1] == (b"later", b"1")


def test_flush_masks_older_runs_and_sorts_across_runs(spark, path):
    s = Store.open_default(spark, path)
    s.put_batch([("b", "1"), ("d", "1"), ("k", "old")])
    s.flush()
    s.put_batch([("a", "2"), ("c", "2")])
    s.delete("k")
    s.flush()
    s.delete("d")
    s = Store.open(spark, path)
    assert s.run_count() == 2
    assert s.get("k") is None and s.get("d") is None
    assert [k for k, _ in state(s)] == [b"a", b"b", b"c"]
    assert [k for k, _ in state(s, "b", "d")] == [b"b", b"c"]
    assert state(s, "b", "b") == [] and state(s, "d", "b") == []
    assert s.flush() is not None and s.flush() is None


def test_empty_value_is_a_delete_before_and_after_reopening(spark, path):
    s = Store.open_default(spark, path)
    s.put("k", "v")
    s.put("k", "")
    assert s.get("k") is None
    s.flush()
    assert Store.open(spark, path).get("k") is None


def test_byte_order_and_prefixes(spark, path):
    s = Store.open_default(spark, path)
    keys = [b"", b"a", b"ab", b"\x7f", b"\x80\x00", b"\xff"]
    s.put_batch([(k, b"v") for k in reversed(keys)])
    assert [k for k, _ in state(s)] == keys
    assert [bytes(r["key"]) for r in s.prefix_scan(b"a").collect()] == [b"a", b"ab"]
    assert [bytes(r["key"]) for r in s.prefix_scan(b"\xff").collect()] == [b"\xff"]
    assert prefix_end(b"a\xff") == b"b" and prefix_end(b"\xff\xff") is None and prefix_end(b"") is None


def test_limits_are_checked_when_writing(spark, path):
    s = Store.open_default(spark, path)
    s.put(b"k" * 65535, b"v" * 65535)
    for k, v in ((b"k" * 65536, b"v"), (b"k", b"v" * 65536)):
        with pytest.raises(InvalidArgument):
            s.put(k, v)
    big = spark.createDataFrame([(bytearray(b"k"), bytearray(b"v" * 65536))], "key binary, value binary")
    with pytest.raises(Exception, match="InvalidArgument"):
        s.put_batch(big)
    with pytest.raises(InvalidArgument):
        Config(block_size=0)


def test_snapshots_survive_writes_flush_and_compaction(spark, path):
    s = Store.open_default(spark, path)
    s.put_batch([("a", "1"), ("b", "1")])
    v = s.snapshot()
    s.put("a", "2")
    s.delete("b")
    want = [(b"a", b"1"), (b"b", b"1")]
    assert state(s, version=v) == want and s.get("b", version=v) == b"1"
    s.flush()
    s.compact(0)
    s.expire_log()  # the snapshot holds the log
    assert state(s, version=v) == want and state(s) == [(b"a", b"2")]
    assert s.min_version() == v and s.is_version_needed(v) and not s.is_version_needed(v + 1)
    s.release_snapshot(v)
    assert s.min_version() is None and not s.is_version_needed(0)
    s.expire_log()
    with pytest.raises(InvalidArgument):
        s.scan(version=v)
    assert state(Store.open(spark, path)) == [(b"a", b"2")]


def test_compaction_levels_and_tombstones(spark, path):
    s = Store.open(spark, path, Config(l0_compaction_threshold=4))
    for i in range(5):
        s.put_batch([(f"k{j}", f"{i}") for j in range(i, i + 3)])
        if i == 4:
            s.delete("k0")
        assert s.needs_compaction() is None
        s.flush()
    assert s.needs_compaction() == 0
    before = state(s)
    assert s.maintain() == 1 and s.run_count() == 1
    run = s._now().runs[0]
    assert run.level == 1 and run.n_rows == len(before) == 6  # nothing older is left, so the deletion is gone
    assert state(s) == before
    s.delete("k1")
    s.flush()
    s.compact(1)  # to level 2
    s.compact(0)  # an older run remains below: the deletion stays
    assert [r.level for r in s._now().runs] == [2, 1] and s.get("k1") is None
    assert s.compact(6) is None and s.compact(3) is None
    with pytest.raises(InvalidArgument):
        s.compact(7)


def test_full_memtable_flushes(spark, path):
    s = Store.open(spark, path, Config(memtable_max_size=200))
    for i in range(4):
        s.put_batch([(f"key{j}", "value" * 4) for j in range(2)])  # overwriting counts too
    assert s.run_count() >= 1 and len(state(s)) == 2


def test_transactions(spark, path):
    s = Store.open_default(spark, path)
    s.put("a", "0")
    tx = Transaction(s)
    tx.put("key1", "x")
    tx.put("key2", "y")
    tx.delete("key1")
    tx.put("key1", "z")
    tx.put("empty", "")
    assert tx.get("key1") == b"z" and tx.get("empty") is None and tx.get("a") == b"0" and s.get("key1") is None
    assert [bytes(r["key"]) for r in tx.scan("a", "key2").collect()] == [b"a", b"key1"]
    before = s.current_version()
    tx.commit()
    assert s.current_version() == before + 1 and s.get("key1") == b"z" and s.get("key2") == b"y"
    for call in (tx.commit, tx.rollback, lambda: tx.get("a"), lambda: tx.put("a", "b"), lambda: tx.delete("a")):
        with pytest.raises(TxNotActive):
            call()
    with Transaction(s) as dropped:
        dropped.put("never", "1")
    assert s.get("never") is None and not dropped.active


def test_transaction_conflicts_are_found_when_asked_for(spark, path):
    s = Store.open_default(spark, path)
    s.put("a", "0")
    tx = Transaction(s)
    tx.get("a")
    tx.put("b", "1")
    s.put("a", "1")
    with pytest.raises(TxConflict):
        tx.commit(check_conflicts=True)
    assert tx.active and s.get("b") is None
    tx.commit()
    assert s.get("b") == b"1"


def test_two_writers(spark, path):
    one, two = Store.open_default(spark, path), Store.open_default(spark, path)
    one.put("a", "1")
    two.put("b", "2")  # sees the other's commit when its own is refused, and tries again
    assert two.current_version() == 2 and [k for k, _ in state(Store.open(spark, path))] == [b"a", b"b"]
    m = Manifests(one._files)
    old = m.newest()
    m.commit(old)
    with pytest.raises(CommitConflict):
        m.commit(old)


def test_multi_get_keeps_misses(spark, path):
    s = Store.open_default(spark, path)
    s.put_batch([("a", "1"), ("b", "2")])
    s.delete("b")
    wanted = spark.createDataFrame([(bytearray(x),) for x in (b"a", b"b", b"c", b"a")] + [(None,)], "key binary")
    got = {bytes(r["key"]): (r["found"], r["value"] and bytes(r["value"])) for r in s.multi_get(wanted, size=5).collect()}
    assert got == {b"a": (True, b"1"), b"b": (False, None), b"c": (False, None)}


def test_streaming_ingest_commits_each_batch_once(spark, path, tmp_path):
    s = Store.open_default(spark, path)
    schema = "n int, op tinyint, key binary, value binary"
    rows = spark.createDataFrame([(1, 0, bytearray(b"a"), bytearray(b"1")), (2, 0, bytearray(b"a"), bytearray(b"2")), (3, 1, bytearray(b"b"), None)], schema)
    rows.coalesce(1).write.parquet(f"{tmp_path}/in/1")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    ingest(stream, s, f"{tmp_path}/cp", ordinal="n", available_now=True).awaitTermination()
    assert state(s) == [(b"a", b"2")]
    version = s.current_version()
    s.write(rows.select("op", "key", "value"), batch=("stream", 0))  # sent again
    assert s.current_version() == version


@pytest.mark.parametrize("seed", [1, 2])
def test_random_operations_against_a_dictionary(spark, path, seed):
    rnd, model, log = random.Random(seed), {}, []
    s = Store.open(spark, path, Config(l0_compaction_threshold=2))
    for _ in range(14):
        what = rnd.random()
        if what < 0.6:
            batch = [(f"k{rnd.randrange(12)}".encode(), rnd.choice([b"", b"x", b"yy", str(rnd.random()).encode()])) for _ in range(rnd.randrange(1, 6))]
            s.put_batch(batch)
            for k, v in batch:
                model[k] = v
            model = {k: v for k, v in model.items() if v}
            log.append((s.current_version(), dict(model)))
        elif what < 0.75:
            k = f"k{rnd.randrange(12)}".encode()
            s.delete(k)
            model.pop(k, None)
            log.append((s.current_version(), dict(model)))
        elif what < 0.85:
            s.flush()
        elif what < 0.93:
            s.maintain()
        else:
            s = Store.open(spark, path, s.config)
    assert state(s) == sorted(model.items())
    a, b, c = b"k1", b"k3", b"k9"
    assert state(s, a, b) + state(s, b, c) == state(s, a, c)
    for k in (b"k1", b"k5", b"nope"):
        assert s.get(k) == model.get(k)
    version, then = rnd.choice(log)
    assert state(s, version=version) == sorted(then.items())


def test_reads_push_the_key_range_to_the_scan(spark, path):
    s = Store.open_default(spark, path)
    s.put_batch([("a", "1"), ("m", "1")])
    s.flush()
    s.put_batch([("x", "1"), ("z", "1")])
    s.flush()
    plan = s.scan("b", "n")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan
    assert len(s._runs([r for r in s._now().runs if r.may_hold(b"b", b"n")]).inputFiles()) == 1  # the other run is pruned
    assert s.rows().where(F.col("op") == 0).count() == 4


def store_at(spark, tmp_path, **settings):
    return Store.open(spark, f"file://{tmp_path}/s", Config(**{"memtable_max_size": 1 << 40} | settings))


def test_expiry_spares_what_another_writer_has_not_committed(spark, tmp_path):
    one, two = store_at(spark, tmp_path), store_at(spark, tmp_path)
    one.put_batch([("a", "1")])

    def meanwhile(m):  # the second writer's rows are on disk, its commit is not
        if one.current_version() == 1:
            one.flush()
            one.put("b", "2")
            one.flush()
            one.expire_log()

    two.refresh()
    two.write(two._local([(0, 0, b"c", b"3")]), "ordinal", only_if=meanwhile)
    again = store_at(spark, tmp_path)
    assert {bytes(r["key"]): bytes(r["value"]) for r in again.view().collect()} == {b"a": b"1", b"b": b"2", b"c": b"3"}


def test_expiry_spares_readers_of_recent_versions(spark, tmp_path):
    one = store_at(spark, tmp_path)
    one.put("a", "1")
    reader = store_at(spark, tmp_path)
    one.flush()
    one.expire_log(0)
    assert [bytes(r["value"]) for r in reader.view().collect()] == [b"1"]
    for i in range(12):
        one.put("a", str(i))
    one.flush()
    one.expire_log(0)
    assert len(one._files.names("log")) <= 12 and one.get("a") == b"11"


def test_conflicts_are_found_after_the_log_expired(spark, tmp_path):
    one = store_at(spark, tmp_path)
    one.put_batch([("a", "1"), ("b", "1")])
    tx = Transaction(one)
    assert tx.get("a") == b"1"
    tx.put("b", "2")
    one.put("a", "other")
    one.flush()
    one.expire_log(0)
    with pytest.raises(TxConflict):
        tx.commit(check_conflicts=True)
    assert one.get("b") == b"1"


def test_a_flush_that_loses_a_race_does_not_fail_the_write(spark, tmp_path, monkeypatch):
    one = store_at(spark, tmp_path, memtable_max_size=1)
    commit = Manifests.commit

    def racing(self, old, **changes):
        if "flushed_seq" in changes:
            raise CommitConflict("another writer was first")
        return commit(self, old, **changes)

    monkeypatch.setattr(Manifests, "commit", racing)
    assert one.put("a", "1") == 1
    assert one.get("a") == b"1" and one._files.names("runs") == []


def test_runs_are_sized_by_their_own_rows(spark, tmp_path):
    one = store_at(spark, tmp_path, run_file_bytes=1000, bloom_bits_per_key=4)
    one.put_batch([(f"k{i:05d}", "v" * 30) for i in range(500)])
    big = one.flush()
    one.put("x", "y")
    small = one.flush()
    files = lambda run: [n for n in one._files.names(run.path) if n.endswith(".parquet")]
    assert len(files(small)) == 1 and len(files(big)) > 10 and big.n_rows == 500
    assert one.multi_get(spark.createDataFrame([("k00007",), ("no",), ("x",)], "key string").selectExpr("cast(key as binary) key")).where("found").count() == 2


def test_lost_files_are_reported_as_corruption(spark, tmp_path):
    one = store_at(spark, tmp_path)
    one.put("a", "1")
    one._files.delete(one._now().segments[0].path)
    with pytest.raises(Corrupted):
        one.view()


def test_a_single_attempt_gives_up_at_once(spark, tmp_path):
    one, two = store_at(spark, tmp_path), store_at(spark, tmp_path, commit_attempts=1)
    one.put("a", "1")
    with pytest.raises(CommitConflict):
        two.put("b", "2")
    two.refresh()
    assert two.put("b", "2") == 2
