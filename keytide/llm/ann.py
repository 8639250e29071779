"""Approximate nearest neighbours over balanced posting lists.

Equal vectors form one class that carries its smallest ids (k + 1 of them, all that any answer can need), so one very
common vector is one entry. A bounded sample of classes is halved again and again into lists of equal size; their
means are the centroids, linked to a neighbour graph that is searched in memory for the entries; queries, which may
need any number of lists, are compared with every centroid. Every class goes to its nearest list and, near a border, to up to ``COPIES`` lists whose distance is within ``BORDER`` of the nearest. A query's lists are
those whose centroid lies within ``RATIO`` of the nearest centroid's distance. Lists are cut into blocks of bounded
size, queries into groups, and each block answers a group with its nearest entries: first the blocks of the few nearest
lists, then the others, which leave out what is farther than k + 1 entries already found; the last step merges them.

What reaches the driver: the sample (``SAMPLE`` vectors), and one size for each list. The centroids that executors get
are bounded by ``LISTS``.

Defined results: vectors that are null, zero, hold null or non-finite components, or have another length than most,
take no part, neither as queries nor as candidates; a row that repeats another's id and vector counts once; ties go to
the smaller id; fewer candidates than k give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import smallest_hashes, trimmed, written

SAMPLE, LISTS, LIST_SIZE = 16384, 1024, 128
COPIES, BORDER = 3, 1.1
RATIO, EDGES = 1.15, 24
#: Lists searched first; entries of a list and queries that one task compares.
NEAR, BLOCK, GROUP, SEED = 4, 4096, 1024, 5


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col("vec")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("id").isNotNull()).where(fine)


def classes(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors: cid (the smallest id) and ids (the k + 1 smallest, ascending)."""
    few = rows.distinct().withColumn("_n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("_n") <= k + 1)
    return few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("cid", F.col("ids")[0])


def halved(x: np.ndarray, lists: int, rng) -> np.ndarray:
    """Centroids of about ``lists`` parts of equal size."""
    parts = [np.arange(len(x))]
    while len(parts) < lists and max(map(len, parts)) > 1:
        parts.sort(key=len, reverse=True)
        part = parts.pop(0)
        p = x[part]
        a, b = p[rng.integers(len(p))], p[rng.integers(len(p))]
        for _ in range(4):
            near = ((p - a) ** 2).sum(axis=1) < ((p - b) ** 2).sum(axis=1)
            if near.all() or not near.any():
                break
            a, b = p[near].mean(axis=0), p[~near].mean(axis=0)
        order = np.argsort(p @ (b - a), kind="stable")
        parts += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
    return np.stack([x[p].mean(axis=0) for p in parts])


class Graph:
    """Centroids with links to near ones, searched by a beam."""

    def __init__(self, centroids: np.ndarray, seed: int = SEED):
        self.c, n = centroids, len(centroids)
        m = min(EDGES, n - 1)
        d = ((centroids**2).sum(axis=1)[:, None] - 2 * centroids @ centroids.T) + (centroids**2).sum(axis=1)[None, :]
        np.fill_diagonal(d, np.inf)
        near = np.argpartition(d, max(m - 1, 0), axis=1)[:, :m] if m else np.zeros((n, 0), int)
        ring = (np.arange(n)[:, None] + np.array([-1, 1])[None, :]) % n  # keeps the graph in one piece
        self.links = np.concatenate([near, ring], axis=1)
        self.start = np.random.default_rng(seed).choice(n, min(16, n), replace=False)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and distances of about the ``beam`` nearest centroids of each row, nearest first; -1 and inf fill up.
        A beam that holds every centroid compares with each."""
        if beam >= len(self.c):
            dist = np.concatenate([np.zeros((0, len(self.c)))] + [((self.c[None] - q[lo : lo + 32, None]) ** 2).sum(axis=2) for lo in range(0, len(q), 32)])
            at = np.argsort(dist, axis=1, kind="stable")
            return at, np.sqrt(np.take_along_axis(dist, at, axis=1))
        rows, every = len(q), np.arange(len(q))
        seen = np.zeros((rows, len(self.c)), bool)
        at = np.broadcast_to(self.start, (rows, len(self.start))).copy()
        dist = ((self.c[at] - q[:, None, :]) ** 2).sum(axis=2)
        seen[every[:, None], at] = True
        open_ = np.ones(at.shape, bool)
        while True:
            pick = np.where(open_, dist, np.inf)
            best = pick.argmin(axis=1)
            live = np.flatnonzero(np.isfinite(pick[every, best]))
            if not live.size:
                break
            open_[live, best[live]] = False
            new = np.full((rows, self.links.shape[1]), -1)
            new[live] = self.links[at[live, best[live]]]
            fresh = (new >= 0) & ~seen[every[:, None], np.maximum(new, 0)]
            first = np.zeros(new.shape, bool)  # a link may name a centroid twice
            order = np.argsort(new, axis=1, kind="stable")
            ordered = np.take_along_axis(new, order, axis=1)
            np.put_along_axis(first, order, np.concatenate([np.ones((rows, 1), bool), ordered[:, 1:] != ordered[:, :-1]], axis=1), axis=1)
            fresh &= first
            r, c = np.nonzero(fresh)
            seen[r, new[r, c]] = True
            far = np.full(new.shape, np.inf)
            far[r, c] = ((self.c[new[r, c]] - q[r]) ** 2).sum(axis=1)
            at, dist = np.concatenate([at, np.where(fresh, new, -1)], axis=1), np.concatenate([dist, far], axis=1)
            open_ = np.concatenate([open_, fresh], axis=1)
            if at.shape[1] > beam:
                keep = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
                at, dist, open_ = (np.take_along_axis(x, keep, axis=1) for x in (at, dist, open_))
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(at, order, axis=1), np.sqrt(np.take_along_axis(dist, order, axis=1))


def listed(df: DataFrame, graph: Graph, beam: int, ratio: float, most: int | None) -> DataFrame:
    """df with a row for each list of its vector, those within ``ratio`` of the nearest (``most`` at most): list and nth (0: nearest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                q = np.array(part.column(part.schema.get_field_index("vec")).to_pylist(), float)
                at, dist = graph.search(q, min(beam, max(len(graph.c), 1)))
                ok = (at >= 0) & (dist <= dist[:, :1] * ratio + 1e-12)
                if most:
                    ok[:, most:] = False
                r, c = np.nonzero(ok)
                out = part.take(pa.array(r))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(at[r, c], pa.int32()), pa.array(c, pa.int32())], names=[*part.schema.names, "list", "nth"])

    return df.mapInArrow(trimmed(run), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", list int, nth int")


def searched(posted: DataFrame, probing: DataFrame, cut: DataFrame, k: int) -> DataFrame:
    """(qid, ids, score): of every block of a probed list its k + 1 nearest classes, none beyond the query's ``most``."""
    left = posted.join(F.broadcast(cut), "list").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    right = probing.join(F.broadcast(cut), "list").withColumn("group", F.pmod(F.xxhash64("qid"), F.col("groups")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def answer(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            v, q = np.stack(a["vec"].to_numpy()), np.stack(b["vec"].to_numpy())
            cid, ids = a["cid"].to_numpy(), a["ids"].to_numpy()
            for qid, x, most in zip(b["qid"].to_numpy(), q, b["most"].to_numpy()):
                d = np.sqrt(((v - x) ** 2).sum(axis=1))
                some = np.flatnonzero(d <= (min(most, np.partition(d, k)[k]) if len(d) > k + 1 else most))
                some = some[np.lexsort((cid[some], d[some]))][: k + 1]
                out += [(qid, ids[j], d[j]) for j in some]
        return pd.DataFrame(out, columns=["qid", "ids", "score"])

    key = ["list", "block", "group"]
    return left.select(*key, "cid", "ids", "vec").groupBy(*key).cogroup(right.select(*key, "qid", "vec", "most").groupBy(*key)).applyInPandas(answer, "qid long, ids array<long>, score double")


def neighbours(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest rows found for each row of ``queries``."""
    spark = df.sparkSession
    good = usable(df, id_col, vec_col)
    sizes = good.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    result = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], result)
    good = good.where(F.size("vec") == sizes[0]["n"])
    entries = written(classes(good, k), "ann-classes")
    n = entries.count()
    sample = smallest_hashes(entries.select("cid", "vec"), F.xxhash64("cid"), SAMPLE, n).select("vec").toPandas()
    x = np.array(sample["vec"].tolist(), float)
    graph = Graph(halved(x, int(min(LISTS, max(1, n // LIST_SIZE))), np.random.default_rng(SEED)))

    asked = usable(queries, id_col, vec_col).where(F.size("vec") == sizes[0]["n"]).distinct()
    wanted = asked.groupBy("vec").agg(F.min("id").alias("qid"))
    posted = written(listed(entries, graph, 32, BORDER, COPIES), "ann-lists")
    probing = written(listed(wanted, graph, LISTS, RATIO, None), "ann-probes")

    # both counts have a row for each list at most
    cut = posted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    cut = cut.join(probing.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("groups")), "list")
    cut = spark.createDataFrame(cut.toPandas(), "list int, blocks int, groups int")

    # the nearest lists bound the distance, so that the others only answer with what may matter
    near = written(searched(posted, probing.where(F.col("nth") < NEAR).withColumn("most", F.lit(float("inf"))), cut, k), "ann-near")
    by_class = near.select("qid", "score", F.col("ids")[0].alias("cid")).distinct()
    by_class = by_class.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy("score", "cid"))).where(F.col("_n") == k + 1)
    most = by_class.select("qid", F.col("score").alias("most"))
    rest = probing.where(F.col("nth") >= NEAR).join(most, "qid", "left").withColumn("most", F.coalesce("most", F.lit(float("inf"))))
    found = near.unionByName(searched(posted, rest, cut, k))
    found = found.select("qid", "score", F.explode("ids").alias("vec_id")).distinct()
    found = found.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy("score", "vec_id"))).where(F.col("_n") <= k + 1).drop("_n")
    rows = asked.join(wanted, "vec").select(F.col("id").alias("query_id"), "qid").join(found, "qid").where("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
