"""A database in a folder: an append-only log, sorted runs made from it, and the manifest that names both.

The log is the truth and serves every version that is not expired; runs make reads of the newest state cheap. Writing
is one Parquet append and one manifest commit; the batch forms are the ones to use.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from keytide.functions.keys import in_range, prefix_end
from keytide.model import DELETE, LOG, MAX_BYTES, PUT, CommitConflict, Config, Corrupted, InvalidArgument, StoreClosed
from keytide.operators import merge, reads
from keytide.operators.resolve import as_of, latest_per_key, live
from keytide.operators.writes import delete_rows, one_commit, put_rows

from .files import Files
from .manifest import Manifest, Manifests, Run, Segment

#: Manifest versions whose files are kept for readers.
KEPT_VERSIONS = 10


def as_bytes(x) -> bytes:
    out = x.encode() if isinstance(x, str) else bytes(x)
    if len(out) > MAX_BYTES:
        raise InvalidArgument(f"longer than {MAX_BYTES} bytes")
    return out


class Store:
    def __init__(self, spark: SparkSession, path: str, config: Config | None = None):
        self.spark, self.path, self.config = spark, path, config or Config()
        self._files = Files(spark, path)
        self._manifests = Manifests(self._files)
        self._manifest: Manifest | None = self._manifests.newest()

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: Config | None = None) -> Store:
        """Recovery is a read: the newest manifest names the runs and the part of the log after them."""
        return cls(spark, path, config)

    @classmethod
    def open_default(cls, spark: SparkSession, path: str) -> Store:
        return cls(spark, path)

    def close(self) -> None:
        self._manifest = None

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _now(self) -> Manifest:
        if self._manifest is None:
            raise StoreClosed("the store is closed")
        return self._manifest

    def refresh(self) -> None:
        """Sees what other writers have committed."""
        self._now()
        self._manifest = self._manifests.newest()

    # writing

    def put(self, key, value) -> int:
        return self.put_batch([(key, value)])

    def delete(self, key) -> int:
        return self.delete_batch([key])

    def _local(self, rows: list[tuple[int, int, bytes, bytes | None]]) -> DataFrame:
        return self.spark.createDataFrame(rows, "ordinal int, op int, key binary, value binary").withColumn("op", F.col("op").cast("tinyint"))

    def put_batch(self, pairs: DataFrame | Iterable, ordinal: str | None = None) -> int:
        """Pairs as a DataFrame (key, value) or an iterable; of equal keys the last counts (by ``ordinal``, or by place)."""
        if isinstance(pairs, DataFrame):
            return self.write(put_rows(pairs), ordinal)
        return self.write(self._local([(i, PUT, as_bytes(k), as_bytes(v)) for i, (k, v) in enumerate(pairs)]), "ordinal")

    def delete_batch(self, keys: DataFrame | Iterable) -> int:
        if isinstance(keys, DataFrame):
            return self.write(delete_rows(keys))
        return self.write(self._local([(i, DELETE, as_bytes(k), None) for i, k in enumerate(keys)]), "ordinal")

    def write(self, rows: DataFrame, ordinal: str | None = None, batch: tuple[str, int] | None = None, only_if=None) -> int:
        """One atomic commit of rows (op, key, value); returns its seq. ``batch``: (source, number), skipped if not new.

        The rows are written first, with the seq of the commit as part of the manifest, so a lost race costs no rewrite.
        ``only_if`` is called with the manifest that the commit builds on and raises to stop it.
        """
        self._now()
        name = f"log/{uuid.uuid4().hex}"
        seen = Observation()
        counted = one_commit(rows, ordinal).observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 16), F.lit(0)).alias("size"))
        counted.write.option("parquet.bloom.filter.enabled#key", "true").parquet(self._files.full(name))
        n, size = seen.get["n"], seen.get["size"]
        for attempt in range(self.config.commit_attempts):
            old = self._now()
            if batch and old.batches.get(batch[0], -1) >= batch[1] or not n:
                self._files.delete(name)
                return old.seq
            if only_if:
                only_if(old)
            seq = old.seq + 1
            try:
                self._manifest = self._manifests.commit(old, seq=seq, segments=(*old.segments, Segment(name, seq, seq, n, size)), batches=old.batches | ({batch[0]: batch[1]} if batch else {}))
                break
            except CommitConflict:
                if attempt == self.config.commit_attempts - 1:
                    self._files.delete(name)
                    raise
                self.refresh()
        if sum(s.bytes for s in self._now().tail()) >= self.config.memtable_max_size:
            try:
                self.flush()
            except CommitConflict:  # the rows are committed; another writer, or the next write, flushes
                self.refresh()
        return seq

    # reading

    def _segments(self, segments: list[Segment]) -> DataFrame:
        """Log rows of segments. Their seq comes from the manifest; segments are read together, a file list at a time."""
        if not segments:
            return self.spark.createDataFrame([], LOG)
        folder = F.regexp_extract(F.col("_metadata.file_path"), "/log/([0-9a-f]{32})/", 1)
        rows = self._read("op tinyint, key binary, value binary", [s.path for s in segments]).withColumn("folder", folder)
        names = self.spark.createDataFrame([(s.path.removeprefix("log/"), s.min_seq) for s in segments], "folder string, seq bigint")
        return rows.join(F.broadcast(names), "folder").select("seq", "op", "key", "value")

    def _read(self, schema: str, paths: list[str]) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(*[self._files.full(p) for p in paths])
        except AnalysisException as e:
            raise Corrupted(f"files that the manifest names cannot be read: {e}") from e

    def _runs(self, runs: list[Run]) -> DataFrame:
        return self._read(LOG, [r.path for r in runs]) if runs else self.spark.createDataFrame([], LOG)

    def rows(self, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        """All rows that decide the newest state of a key range: runs that can hold it, and the log after them."""
        m = self._now()
        both = self._runs([r for r in m.runs if r.may_hold(start, end)]).unionByName(self._segments(m.tail()))
        return both.where(in_range(F.col("key"), start, end))

    def log_since(self, version: int) -> DataFrame:
        """The log after a version; only its segments are read."""
        m = self._now()
        if version < m.log_start:
            raise InvalidArgument(f"the log after version {version} is gone; it starts at {m.log_start}")
        return self._segments([s for s in m.segments if s.max_seq > version]).where(F.col("seq") > version)

    def log(self, version: int | None = None) -> DataFrame:
        """The log up to a version; versions before log_start cannot be read any more."""
        m = self._now()
        if version is not None and version < m.log_start:
            raise InvalidArgument(f"version {version} is older than the log, which starts at {m.log_start}")
        return as_of(self._segments([s for s in m.segments if version is None or s.min_seq <= version]), version)

    def _at(self, version: int | None, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        if version is None:
            return self.rows(start, end)
        rows = self.log(version)
        return rows.where(in_range(F.col("key"), start, end))

    def get(self, key, version: int | None = None) -> bytes | None:
        key = as_bytes(key)
        got = reads.get(self._at(version, key, key + b"\0"), bytearray(key)).collect()
        return bytes(got[0]["value"]) if got else None

    def multi_get(self, keys: DataFrame, version: int | None = None, size: int | None = None) -> DataFrame:
        """(key, found, value) of each wanted key; runs outside the range of the keys are not read."""
        low, high = keys.agg(F.min("key"), F.max("key")).first()
        if low is None:
            return reads.multi_get(self._at(version, b"", b""), keys, size)
        return reads.multi_get(self._at(version, bytes(low), bytes(high) + b"\0"), keys, size)

    def scan(self, start=None, end=None, version: int | None = None, limit: int | None = None) -> DataFrame:
        start, end = (None if x is None else as_bytes(x) for x in (start, end))
        out = live(latest_per_key(self._at(version, start, end))).select("key", "value").orderBy("key")
        return out if limit is None else out.limit(limit)

    def prefix_scan(self, prefix, version: int | None = None) -> DataFrame:
        prefix = as_bytes(prefix)
        return self.scan(prefix, prefix_end(prefix), version)

    def view(self, version: int | None = None) -> DataFrame:
        return live(latest_per_key(self._at(version))).select("key", "value")

    # counters and versions

    def memtable_size(self) -> int:
        """Keys in the log after the runs, deletions included. Answers on a closed store like run_count, with 0."""
        return self._segments(self._manifest.tail()).select("key").distinct().count() if self._manifest else 0

    def run_count(self) -> int:
        return len(self._manifest.runs) if self._manifest else 0

    def current_version(self) -> int:
        return self._now().seq

    def _change(self, change) -> None:
        for attempt in range(self.config.commit_attempts):
            try:
                self._manifest = self._manifests.commit(self._now(), **change(self._now()))
                return
            except CommitConflict:
                if attempt == self.config.commit_attempts - 1:
                    raise
                self.refresh()

    def snapshot(self) -> int:
        """Registers the current version; reads at it stay possible until it is released."""
        self._change(lambda m: {"snapshots": (*m.snapshots, (m.seq, time.time()))})
        return self._now().snapshots[-1][0]

    def release_snapshot(self, version: int) -> None:
        self._change(lambda m: {"snapshots": tuple(s for s in m.snapshots if s[0] != version)})

    def min_version(self) -> int | None:
        return min((v for v, _ in self._now().snapshots), default=None)

    def is_version_needed(self, version: int) -> bool:
        return any(v >= version for v, _ in self._now().snapshots)

    # maintenance

    def _write_run(self, rows: DataFrame, level: int, run_id: int, n_bytes: int, n_rows: int) -> Run | None:
        """A sorted run of rows that come from ``n_rows`` rows of ``n_bytes`` bytes, which size its files and their Bloom filters."""
        name = f"runs/{run_id:08d}-{uuid.uuid4().hex[:8]}"
        parts = max(1, -(-n_bytes // self.config.run_file_bytes))
        seen = Observation()
        # observed above the exchange, whose sampling of ranges would count rows twice
        ordered = rows.select("seq", "op", "key", "value").repartitionByRange(parts, "key").sortWithinPartitions("key").observe(seen, *merge.run_columns())
        # a filter of b bits for each key misses absent keys at a rate of about 0.6185 ** b
        options = {"enabled": "true", "expected.ndv": str(max(1, -(-n_rows // parts))), "fpp": f"{max(1e-9, 0.6185**self.config.bloom_bits_per_key):.12f}"}
        ordered.write.options(**{f"parquet.bloom.filter.{k}#key": v for k, v in options.items()}, **{"parquet.page.size": str(max(1024, self.config.block_size))}).parquet(self._files.full(name))
        s = seen.get
        if not s["n_rows"]:
            self._files.delete(name)
            return None
        return Run(run_id, level, name, bytes(s["min_key"]).hex(), bytes(s["max_key"]).hex(), s["n_rows"], s["bytes"], s["min_seq"], s["max_seq"])

    def _publish(self, old: Manifest, run: Run | None, **changes) -> None:
        """Commits a manifest with a new run; the run's files go if another writer was first."""
        try:
            self._manifest = self._manifests.commit(old, next_run=old.next_run + 1, **changes)
        except CommitConflict:
            if run:
                self._files.delete(run.path)
            raise

    def flush(self) -> Run | None:
        """Makes a run at level 0 of the log after the last flush; deletions are kept, the log stays."""
        m = self._now()
        tail = m.tail()
        if not tail:
            return None
        run = self._write_run(latest_per_key(self._segments(tail)), 0, m.next_run, sum(s.bytes for s in tail), sum(s.n_rows for s in tail))
        self._publish(m, run, flushed_seq=m.seq, runs=(*m.runs, *([run] if run else [])))
        return run

    def needs_compaction(self) -> int | None:
        m = self._now()
        return merge.needs_compaction(merge.levels(self.spark, m.table(self.spark), self.config.max_levels), self.config).first()["level"]

    def compact(self, level: int) -> Run | None:
        """Merges all runs of a level and the next into one run there. Nothing happens at the last level or without runs.

        Deletions go when no run outside the merge is left that is older, that is, none at a deeper level.
        """
        m = self._now()
        if level < 0 or level >= self.config.max_levels:
            raise InvalidArgument(f"there is no level {level}")
        if level == self.config.max_levels - 1 or not m.level(level):
            return None
        taken = m.level(level) + m.level(level + 1)
        older = [r for r in m.runs if r.level > level + 1]
        run = self._write_run(merge.compacted(self._runs(taken), not older), level + 1, m.next_run, sum(r.bytes for r in taken), sum(r.n_rows for r in taken))
        kept = tuple(r for r in m.runs if r not in taken)
        self._publish(m, run, runs=(*kept, *([run] if run else [])))
        return run

    def maintain(self) -> int:
        """Compacts until no level needs it; the number of compactions."""
        done = 0
        while (level := self.needs_compaction()) is not None and level < self.config.max_levels - 1:
            self.compact(level)
            done += 1
        return done

    def expire_log(self, grace: float | None = None) -> None:
        """Drops log segments that are in runs and that no snapshot needs; then removes files that nobody can need.

        Those are files that none of the last KEPT_VERSIONS manifests names and that were last changed ``grace`` seconds
        ago or more (Config.expire_grace): other writers' files that are not committed yet, and those of readers of
        recent versions, stay.
        """

        def change(m: Manifest) -> dict:
            oldest = min([m.flushed_seq, *(v for v, _ in m.snapshots)])
            if m.snapshots:  # a snapshot is read from the log's beginning
                return {}
            return {"segments": tuple(s for s in m.segments if s.max_seq > oldest), "log_start": max(m.log_start, oldest)}

        self._change(change)
        grace = self.config.expire_grace if grace is None else grace
        found = [f"{folder}/{name}" for folder in ("log", "runs") for name in self._files.names(folder)]
        self._manifests.expire(KEPT_VERSIONS)
        named = {x.path for m in self._manifests.recent(KEPT_VERSIONS) for x in (*m.segments, *m.runs)}
        for name in found:
            if name not in named and self._files.age(name) >= grace:
                self._files.delete(name)
