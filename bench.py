"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from keytide.model import Config
from keytide.plans import catalogue, fixtures
from keytide.sources.store import Store

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")
HEADLINE = ["lww_view", "range_scan", "snapshot_view", "multi_get", "batch_overwrite", "bulk_delete", "tx_overlay_commit", "flush_run", "compact_gc", "recovery_view", "bloom_probe"]


def timed(f) -> float:
    began = time.perf_counter()
    f()
    return round(time.perf_counter() - began, 3)


def drained(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    drained(queries["lww_view"](spark, SF))  # starts the JVM's compiler
    out = {}
    for name in HEADLINE:
        drained(queries[name](spark, SF))
        out[name] = timed(lambda: drained(queries[name](spark, SF)))

    # batch forms of the store's calls, on disk
    folder = tempfile.mkdtemp(prefix="keytide-bench-")
    try:
        store = Store.open(spark, f"file://{folder}/db", Config(memtable_max_size=1 << 40))
        line, _ = fixtures.lineitem(spark, SF)
        rows = line.select(F.concat("key", F.lit("/"), F.col("l_partkey").cast("string")).cast("binary").alias("key"), F.col("value").cast("binary").alias("value")).cache()
        n = rows.count()
        out["store_bulk_put"] = timed(lambda: store.put_batch(rows))
        out["store_flush"] = timed(store.flush)
        for i in range(9):
            store.put_batch(rows.where(F.pmod(F.xxhash64("key"), F.lit(10)) == i))
            store.flush()
        out["store_full_view"] = timed(lambda: drained(store.view()))
        low, high = (bytes(r) for r in rows.selectExpr("min(substr(key, 1, 6)) a", "max(key) b").first())
        some = [bytes(r["key"]) for r in rows.orderBy("key").select("key").limit(n // 100 + 1).collect()]
        out["store_range_scan_1pct"] = timed(lambda: drained(store.scan(some[0], some[-1])))
        wanted = rows.select("key").limit(100_000).cache()
        wanted.count()
        out["store_multi_get_100k"] = timed(lambda: drained(store.multi_get(wanted, size=100_000)))
        out["store_compact_10_runs"] = timed(lambda: store.compact(0))
        out["store_bulk_delete_half"] = timed(lambda: store.delete_batch(rows.where(F.pmod(F.xxhash64("key"), F.lit(2)) == 0).select("key")))
        rates = {"bulk_put_rows_per_s": round(n / out["store_bulk_put"]), "multi_get_keys_per_s": round(100_000 / out["store_multi_get_100k"]), "rows": n, "span": [low.hex(), high.hex()]}
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "rates": rates, "sf": SF}))
    spark.stop()


if __name__ == "__main__":
    main()
