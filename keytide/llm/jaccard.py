"""Exact n-gram Jaccard self-join, size-aware (heavy and light sets), that yields components instead of all pairs.

Texts become sets of k-word shingles, told apart by 64-bit hashes and never by text; equal sets (by 128 bits) form a
class, represented by its smallest id. Two sets with similarity num / den or more share at least ceil(num * n / den)
shingles (n: the size of either), so the first p = n - ceil(num * n / den) + s of both in any common order share at
least s. The order is by rarity, in two rounds: estimated from a word-count sketch of fixed size first; then shingles
that the first round met under ``DEMOTE`` sets or more come last, and only sets of which s shingles or more have company
are listed again. What is left of a set are its listed shingles that other sets have too; q is their number.

* Large sets (q above the boundary) scan the inverted lists of these shingles and keep sets met in at least s lists.
* Small sets (q up to the boundary) enumerate all subsets of fixed size s instead: two small sets are candidates if
  they have a subset in common.
* The boundary is chosen by cost, counted over all sets: steps of scanning against subset keys.

Lists and subset keys of fewer than ``HOT`` sets yield their pairs. Longer ones, however long, do not: their sets are
verified against one hub and linked through it (see hub_links). Verification is exact on the hashes of whole sets, and
sends each set once to each bounded cell of pairs.

Defined results: null text, and text without words, have an empty set and no links; a text of fewer than k words has
one shingle, its whole sequence; a null id has no component (null) and links nothing; rows that share an id count as
one document; rows that repeat get equal results; an empty table gives no rows; a text of any length is one set. Only
the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .routing import chosen, key_bits, marking
from .scratch import dropped, released, trimmed, written
from .words import LOWER, Texts, gram_hashes, i64, mix, slices, within, word_hashes, words

#: Cells of the word-count sketch.
CELLS = 1 << 17
#: Listed shingles that a pair must share (at most); sets under a key from which a hub takes the place of pairs.
SHARED, HOT = 6, 32
#: Sets under a shingle from which it comes last in the second order.
DEMOTE = 4
#: Cost of a subset key against a step of scanning; either makes one row of a table that is counted by key.
KEY_COST = 1.0
#: Shingles in a cell of pairs that one task verifies.
CELL_TOKENS = 1 << 18
SIDES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def shingles(t: Texts, k: int, weight: np.ndarray | None = None, late: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a slice, text by text, rarest first, with text i's at at[i]:at[i + 1]; and the word hashes.

    weight: of words by cell; late: bitmap of shingles that come last. Without both a text's shingles ascend.
    """
    data = LOWER[t.data]
    w = words(t, data)
    h = word_hashes(data, w)
    ok = np.flatnonzero(within(w, k))
    value = gram_hashes(h, k)[ok]
    own = w.owner()
    n = w.counts()
    level = np.zeros(h.size, np.int64) if weight is None else weight[(h % np.uint64(CELLS)).astype(np.int64)].astype(np.int64)
    score = sum(level[ok + j] for j in range(k))
    short = np.flatnonzero((n > 0) & (n < k))
    if short.size:
        extra = np.array([mix(np.array([sum(int(x) * pow(SIDES[0], j + 1, 2**64) for j, x in enumerate(h[w.at[i] : w.at[i + 1]])) % 2**64 + int(n[i])], np.uint64))[0] for i in short], np.uint64)
        value, score = np.concatenate([value, extra]), np.concatenate([score, [int(level[w.at[i] : w.at[i + 1]].sum()) for i in short]])
        own = np.concatenate([own[ok], short])
    else:
        own = own[ok]
    if late is not None:
        at = value & np.uint64(late.size * 8 - 1)
        score = score + (((late[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(np.int64) << 40)
    order = np.lexsort((value, score, own))
    value, own = value[order], own[order]
    new = np.ones(value.size, bool)
    new[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
    value, own = value[new], own[new]
    return value, np.searchsorted(own, np.arange(t.rows + 1)), h


def signature(value: np.ndarray, at: np.ndarray, side: int) -> np.ndarray:
    """A sum over each set, the same for equal sets in any order."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value ^ np.uint64(side)), dtype=np.uint64)])
    return total[at[1:]] - total[at[:-1]]


def least_overlap(n, num: int, den: int):
    """The fewest shingles that a set of size n shares with a similar one."""
    return -(-num * n // den)


def censused(texts: DataFrame, k: int) -> DataFrame:
    """kind 0: id, n and signature (a, b) of every text; kind 1: cell (a) and count (n) of a task's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        names = ["kind", "id", "n", "a", "b"]
        for batch in batches:
            for t in slices(batch.column(1)):
                value, at, h = shingles(t, k)
                cells += np.bincount((h % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(t.rows, np.int32)), batch.column(0).slice(t.first, t.rows), pa.array(np.diff(at)), *(pa.array(i64(signature(value, at, s))) for s in SIDES)], names=names)
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(at.size, np.int32)), pa.nulls(at.size, pa.int64()), pa.array(cells[at]), pa.array(at), pa.array(np.zeros(at.size, np.int64))], names=names)

    return written(texts.select("id", "text").mapInArrow(trimmed(run), "kind int, id long, n long, a long, b long"), "sets")


def prefixed(texts: DataFrame, k: int, num: int, den: int, weight: np.ndarray, shared: int, ids: DataFrame | None = None, late: np.ndarray | None = None) -> DataFrame:
    """(key, a, core): the p rarest shingles of every set that can have a partner, with the set's signature; a task's equal sets once.

    core: of the first that a set needs beside one that is no smaller, which shares 2 * num / (num + den) of it at least.
    ids: only these (and a few others) are read; late: as in shingles().
    """
    rows, keep = (texts.select("text"), None) if ids is None else marking(texts.select("text", "id"), ids, "id")
    late = None if late is None else texts.sparkSession.sparkContext.broadcast(late)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            batch = keep(batch) if keep else batch
            for t in slices(batch.column(0)):
                value, at, _ = shingles(t, k, weight, None if late is None else late.value)
                a = i64(signature(value, at, SIDES[0]))
                n = np.diff(at)
                new = np.zeros(t.rows, bool)
                for i, x in enumerate(a.tolist()):
                    if x not in seen:
                        seen.add(x)
                        new[i] = True
                need = least_overlap(n, num, den)
                # different sets are similar at the least with one shingle more in one: n of n + 1
                p = np.where(new & (n > 0) & (den * n >= num * (n + 1)), np.minimum(n - need + shared, n), 0)
                own = np.repeat(np.arange(t.rows), p)
                place = np.arange(own.size) - np.repeat(np.cumsum(p) - p, p)
                core = place < (n - least_overlap(2 * n, num, num + den) + shared)[own]
                yield pa.RecordBatch.from_arrays([pa.array(i64(value[place + at[:-1][own]])), pa.array(a[own]), pa.array(core)], names=["key", "a", "core"])

    return written(rows.mapInArrow(trimmed(run), "key long, a long, core boolean"), "prefixes")


def with_company(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of lists (key, a, core): the keys of more than one set, one of them by a core entry, with about how many, f; and the entries under them, each once."""
    keys = lists.groupBy("key").agg(F.min("a").alias("lo"), F.max("a").alias("hi"), F.sum(F.when(F.col("core"), F.lit(1 << 32)).otherwise(F.lit(0)) + 1).alias("both"))
    # both: cores and entries in one number, as this table is the largest that is aggregated
    keys = keys.where(F.col("lo") < F.col("hi")).where(F.col("both") >= 1 << 32)
    keys = written(keys.select("key", (F.col("both") % (1 << 32)).alias("f")), "keys")
    return keys, chosen(lists, keys, ["key"]).join(keys.select("key"), "key", "left_semi").distinct()


def collected(texts: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(id, shingles) of the sets with these ids, and of few others: all shingles in ascending order, as bytes."""

    rows, keep = marking(texts.select("id", "text"), members, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = keep(batch)
            for t in slices(batch.column(1)):
                value, at, _ = shingles(t, k)
                raw = pa.Array.from_buffers(pa.binary(), t.rows, [None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(value.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, t.rows), raw], names=["id", "shingles"])

    return written(rows.mapInArrow(trimmed(run), "id long, shingles binary").where("length(shingles) > 0"), "members")


def band(n: str, num: int, den: int):
    """Sizes by factors of den / num and a little: similar sets are in one band or in neighbouring ones."""
    return F.floor(F.log(n) / F.lit(np.log(1.01 * den / num))).cast("int")


def banded(lists: DataFrame, num: int, den: int) -> DataFrame:
    """(key, band, id, n, core): every set in its own band and, as a guest, in the next, so that lists hold similar sizes only."""
    own = band("n", num, den)
    rows = lists.select("key", "id", "n", "core", F.explode(F.array(own, own + 1)).alias("band"))
    return rows.select(F.xxhash64("key", "band").alias("key"), "band", "id", "n", "core")


def lengths(lists: DataFrame) -> DataFrame:
    """lists with f, the sets under each key, and cores, those with a core entry; without keys that hold no pair."""
    return lists.join(lists.groupBy("key").agg(F.count(F.lit(1)).alias("f"), F.count_if("core").alias("cores")).where("f > 1 AND cores > 0"), "key")


def useful(least) -> tuple:
    """Whether entries (with core and cores) are enough for a set to be the smaller or the larger one of a pair: aggregates to compare."""
    return F.count_if("core") >= least, F.count_if(F.col("cores") > F.col("core").cast("int")) >= least


def subset_keys(small: DataFrame, size: int) -> DataFrame:
    """(key, band, id, n, q, core): all subsets of ``size`` listed shingles of each set; core: all of its entries are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = part.column(4)
                count = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().field("key").to_numpy(zero_copy_only=False).view(np.uint64)
                is_core = lists.flatten().field("core").to_numpy(zero_copy_only=False)
                start = np.cumsum(count) - count
                keys, rows, cores = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
                for q in np.unique(count[count >= size]):
                    of = np.flatnonzero(count == q)
                    place = start[of][:, None] + np.arange(q)
                    place = np.take_along_axis(place, np.argsort(flat[place], axis=1), axis=1)
                    at = np.array(list(combinations(range(int(q)), size)))
                    key, core = np.zeros((of.size, len(at)), np.uint64), np.ones((of.size, len(at)), bool)
                    for j in range(size):
                        key = mix(key * np.uint64(SIDES[0]) + flat[place[:, at[:, j]]])
                        core &= is_core[place[:, at[:, j]]]
                    keys.append(key.ravel())
                    cores.append(core.ravel())
                    rows.append(np.repeat(of, len(at)))
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(i64(np.concatenate(keys))), *(part.column(c).take(at) for c in range(4)), pa.array(np.concatenate(cores))], names=["key", "band", "id", "n", "q", "core"])

    return small.groupBy("band", "id", "n", "q").agg(F.collect_list(F.struct("key", "core")).alias("keys")).mapInArrow(trimmed(run), "key long, band int, id long, n long, q int, core boolean")


def most_enumerable(shared: int) -> int:
    """The largest q at which subsets can cost less than scanning, whose steps are fewer than HOT for each entry."""
    q = shared
    while shared > 1 and KEY_COST * math.comb(q + 1, shared) < (q + 1) * HOT:
        q += 1
    return q


def boundary_by_cost(lists: DataFrame, shared: int) -> int:
    """The number of listed shingles up to which sets are small. ``lists``: (key, band, id, n, core, q, f, cores).

    Costs are summed over all sets by q: scanning costs a step for each pair in a list that an entry leads to (one for a list
    with a hub), enumerating KEY_COST steps for each subset.
    """
    most = most_enumerable(shared)
    steps = F.when(F.col("cores") >= HOT, F.lit(1)).when(F.col("core"), F.col("f") - 1).otherwise(F.col("cores"))
    cost = lists.where(F.col("q") <= most).groupBy("q").agg(F.sum(steps).alias("scan"), F.count_distinct("id", "band").alias("sets")).collect()
    gain, best, boundary = 0.0, 0.0, 0
    for r in sorted(cost, key=lambda r: r["q"]):
        gain += r["scan"] - KEY_COST * math.comb(r["q"], shared) * r["sets"]
        if gain > best:
            best, boundary = gain, r["q"]
    return boundary


def similar_sizes(a: str, b: str, num: int, den: int):
    return F.least(a, b) * den >= F.greatest(a, b) * num


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, residual: bool = False) -> DataFrame:
    """pairs (a, b, n_b, home) with link, exactly; with ``residual`` (a: the hub of b) also n (b's size), o (shingles in
    common), x and x2 (the fewest shingles outside the hub, one at least, that b shares with a similar set which it does
    not share enough of the hub with; x2: if that set is no smaller than b), rest (b's first shingles outside the hub in
    the order of hashes, which hold SHARED of those x, or all) and cores (how many of them hold SHARED of those x2).

    Pairs are laid out in cells of bounded size: those of one ``home`` (a set that many of them are near to) form a
    grid by a and b, small homes share cells; each set is sent once to each cell that has a pair of it.
    """
    size = pairs.groupBy("home").agg(F.sum("n_b").alias("w"), F.approx_count_distinct("a").alias("da"), F.approx_count_distinct("b").alias("db"))
    m = F.ceil(F.col("w") / CELL_TOKENS)
    size = size.withColumn("ma", F.ceil(F.sqrt(m * F.col("da") / F.col("db")))).withColumn("mb", F.ceil(m / F.col("ma")))
    size = written(size.select("home", "w", F.col("ma").cast("int").alias("ma"), F.col("mb").cast("int").alias("mb")), "homes")
    few = size.where("ma * mb = 1").agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    many = max(1, -(-int(few) // CELL_TOKENS), int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")) if few > CELL_TOKENS // 8 else 1)
    alone = F.col("ma") * F.col("mb") > 1
    laid = pairs.join(size, "home").select(
        "a", "b", F.when(alone, F.col("home")).otherwise(F.pmod(F.xxhash64("home"), F.lit(many))).alias("c"), alone.alias("big"),
        F.pmod(F.xxhash64("a"), F.col("ma")).cast("int").alias("i"), F.pmod(F.xxhash64("b"), F.col("mb")).cast("int").alias("j"),
    )
    laid = written(laid, "cells")
    cell = ["c", "big", "i", "j"]
    sent = laid.select(*cell, F.col("a").alias("id")).unionByName(laid.select(*cell, F.col("b").alias("id"))).distinct()
    sent = sent.join(chosen(sets, sent.select("id").distinct(), ["id"]), "id")  # sets without a pair are not shuffled

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        have: dict[int, list[np.ndarray]] = {}
        for i, raw in zip(right.column("id").to_pylist(), right.column("shingles").combine_chunks() if right.num_rows else []):
            have.setdefault(i, []).append(np.frombuffer(raw.as_buffer(), np.uint64))
        a, b, size, link, common, least, core, rest = [], [], [], [], [], [], [], []
        for x, y in zip(left.column("a").to_pylist(), left.column("b").to_pylist()):
            for u in have.get(x, ()):  # more than one only where rows share an id
                for v in have.get(y, ()):
                    both = np.concatenate([u, v])
                    both.sort(kind="stable")
                    n = int((both[1:] == both[:-1]).sum())
                    a.append(x)
                    b.append(y)
                    size.append(v.size)
                    link.append(den * n >= num * (u.size + v.size - n))
                    if residual:
                        x, x2 = max(1, least_overlap(v.size, num, den) - n), max(1, least_overlap(2 * v.size, num, num + den) - n)
                        common.append(n)
                        least.append((x, x2))
                        core.append(v.size - n - x2 + SHARED)
                        rest.append(i64(v[~np.isin(v, u, assume_unique=True)][: v.size - n - x + SHARED]))
        cols = {"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "link": pa.array(link, pa.bool_())}
        if residual:
            cols |= {"n": pa.array(size, pa.int64()), "o": pa.array(common, pa.int64()), "x": pa.array([i for i, _ in least], pa.int64()), "x2": pa.array([i for _, i in least], pa.int64()), "cores": pa.array(core, pa.int64()), "rest": pa.array(rest, pa.list_(pa.int64()))}
        return pa.table(cols)

    sent = sent.select(*[F.col(c).alias(f"{c}_") for c in cell], "id", "shingles")
    out = laid.groupBy(*cell).cogroup(sent.groupBy(*[f"{c}_" for c in cell])).applyInArrow(run, "a long, b long, link boolean" + ", n long, o long, x long, x2 long, cores long, rest array<long>" * residual)
    return written(out, "verified")


def with_component(rows: DataFrame, label: DataFrame | None) -> DataFrame:
    """rows with the component of their id, itself where it has no link yet."""
    if label is None:
        return rows.withColumn("component", F.col("id"))
    return rows.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def paired(keys: DataFrame, num: int, den: int, more: list[str]) -> DataFrame:
    """Pairs of different components under keys (key, id, n, core, component): the smaller set (by size, then id; columns _a)
    by a core entry, the larger one (_b) by any."""
    x, y = (rows.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "component", *more)]) for s, rows in (("a", keys.where("core")), ("b", keys)))
    smaller = (F.col("n_a") < F.col("n_b")) | (F.col("n_a") == F.col("n_b")) & (F.col("id_a") < F.col("id_b"))
    return x.join(y, "key").where(smaller & (F.col("component_a") != F.col("component_b")) & similar_sizes("n_a", "n_b", num, den))


def light_pairs(keys: DataFrame, label: DataFrame, num: int, den: int, shared: int, boundary: int) -> DataFrame:
    """(a, b, n_b) of sets in different components that meet under at least ``shared`` keys, of similar sizes, one of them with q above ``boundary``."""
    met = paired(with_component(keys, label), num, den, ["q", "band"])
    # two guests meet in their own band
    met = met.where((band("n_b", num, den) == F.col("band_b")) & (F.greatest("q_a", "q_b") > boundary))
    return met.groupBy(F.col("id_a").alias("a"), F.col("id_b").alias("b")).agg(F.count(F.lit(1)).alias("k"), F.max("n_b").alias("n_b")).where(F.col("k") >= shared).select("a", "b", "n_b")


def at_home(pairs: DataFrame) -> DataFrame:
    """pairs with home: the smallest set that b is paired with."""
    return pairs.join(pairs.groupBy("b").agg(F.min("a").alias("home")), "b")


def undone(keys: DataFrame, most: int) -> DataFrame:
    """Keys with sets of different components, not all of them similar to the hub, and at least one core entry; long: those
    with more pairs to look at than ``most`` for each set."""
    n = keys.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("f"), F.count_if(~F.col("link")).alias("apart"), F.count_if("core").alias("cores"), F.count_if(F.col("core") & ~F.col("link")).alias("both"))
    pairs = F.col("both") * F.col("f") + (F.col("cores") - F.col("both")) * F.col("apart")
    return n.where("lo < hi AND apart > 0 AND cores > 0").select("key", "cores", (pairs >= F.lit(most) * F.col("f")).alias("long"))


def hub_links(hot: DataFrame, sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that join all similar sets under keys of very many sets; ``hot`` has key, id and n, the set's size.
    And the components of the links to the first hubs, by which pairs that need no verification are left out.

    Each key's hub is that of its sets which stands under the most keys; the group of a hub is everything under its keys.
    All members are verified against the hub, one pair each. Let u and v be similar members, in different components
    of the links to the first hubs, h the hub, o what a set shares with it and c the overlap that u and v need. Then one of them,
    say u, is not similar to h, and either

    * both share c or more with h, so v is smaller than h: such members stand under one new key of the hub, the smaller
      ones as its core, or
    * u and v share at least c - min(o, o) shingles outside h, so they meet under some of their first shingles outside it,
      which become new keys of the hub. A member under fewer new keys with company than that, or than SHARED, is left out.

    New keys whose sets are all in one component, or all similar to the hub, are done. Those with few sets that are not
    similar to the hub yield the pairs of these with all others of different components; the rest get hubs in turn. A
    group in which no hub is similar to many (each one's copies differ from all others' in other places) gains little by
    them, so each step pairs out lists with eight times as many pairs for each set as the last one did.
    """
    links = written(hot.sparkSession.createDataFrame([], "a long, b long"), "links-so-far")
    most, label = 8 * HOT, None
    while not hot.isEmpty():
        wide = hot.groupBy("id").agg(F.count(F.lit(1)).alias("c"))
        hubs = hot.join(wide, "id").groupBy("key").agg(F.min(F.struct(-F.col("c"), "id")).alias("h")).select("key", F.col("h.id").alias("hub"))
        group = hot.join(hubs, "key").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("hub").alias("home")).distinct()
        near = verified(written(group, "hub-groups"), sets, num, den, residual=True)
        released(hot.sparkSession)
        links = written(links.unionByName(near.where("link").select("a", "b")), "links-so-far")
        label = written(components(links), "labels") if label is None else label

        near = with_component(near.withColumnsRenamed({"a": "hub", "b": "id", "cores": "first"}), label)
        size = hot.select(F.col("id").alias("hub"), F.col("n").alias("size")).distinct()
        member = ["hub", "id", "n", "o", "x", "x2", "link", "component"]
        inner = near.where(F.col("o") * den >= F.col("n") * num).join(size, "hub").where("NOT link OR n < size").select(*member, F.xxhash64("hub").alias("key"), (F.col("n") < F.col("size")).alias("core"), F.lit(True).alias("inner"))
        outer = near.select(*member, "first", F.posexplode("rest").alias("i", "t")).select(*member, F.xxhash64("hub", "t").alias("key"), (F.col("i") < F.col("first")).alias("core"), F.lit(False).alias("inner"))
        keys = written(inner.unionByName(outer), "outside")
        met = keys.join(undone(keys, most), "key")
        small, large = F.count_if(F.col("core") & ~F.col("inner")), F.count_if((F.col("cores") > F.col("core").cast("int")) & ~F.col("inner"))
        rich = met.groupBy("hub", "id").agg(small.alias("c2"), large.alias("c"))
        enough = (F.col("c") >= F.least("x", F.lit(SHARED))) | (F.col("c2") >= F.least("x2", F.lit(SHARED)))
        had, keys = keys, written(met.join(rich, ["hub", "id"]).where(F.col("inner") | enough).select(*member, "key", "core", "inner"), "outside")
        dropped(had)
        had, keys = keys, written(keys.join(undone(keys, most).select("key", "long"), "key"), "outside")
        dropped(had)

        met = paired(keys.where("NOT long"), num, den, ["o", "link", "inner"]).where("NOT (link_a AND link_b)")
        met = met.where(~F.col("inner_a") | (F.least("o_a", "o_b") * (num + den) >= (F.col("n_a") + F.col("n_b")) * num))
        rest = written(met.groupBy(F.col("id_a").alias("a"), F.col("id_b").alias("b")).agg(F.max("n_b").alias("n_b")), "hub-rest")
        found = verified(written(at_home(rest), "hub-rest"), sets, num, den)
        links = written(links.unionByName(found.where("link").select("a", "b")), "links-so-far")
        hot, most = written(keys.where("long").select("key", "id", "n").distinct(), "hot"), 8 * most
        released(hot.sparkSession)
    return links, label


def listed(texts: DataFrame, classes: DataFrame, k: int, num: int, den: int, weight: np.ndarray, shared: int) -> DataFrame:
    """(key, id, n, core): the listed shingles with company of every set that can have a partner, after both rounds."""
    lists = prefixed(texts, k, num, den, weight, shared)
    keys, entries = with_company(lists)
    entries = written(entries, "entries")
    rich = entries.groupBy("a").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= shared).select("a")
    ids = written(classes.join(rich, "a").select("id"), "rich")
    late = key_bits(keys.where(F.col("f") >= DEMOTE), ["key"], hashed=True)
    for table in (lists, entries):
        dropped(table)
    released(texts.sparkSession)
    lists = prefixed(texts, k, num, den, weight, shared, ids, late)
    keys, entries = with_company(lists)
    out = written(entries.join(classes.select("a", "id", "n"), "a").select("key", "id", "n", "core"), "entries")
    dropped(lists)
    released(texts.sparkSession)
    return out


def joined(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """id, n_shingles and component_id of every row; texts link at similarity num / den or more."""
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    census = censused(texts, k)
    rows = census.where("kind = 0").drop("kind")
    cells = census.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).toPandas()
    count = np.zeros(CELLS)
    count[cells["a"].to_numpy(int)] = cells["n"].to_numpy(float)
    weight = np.rint(8 * np.log2(1 + count)).astype(np.int16)

    least = -(-num // (den - num))  # the smallest set that a different one can be similar to
    shared = min(SHARED, int(least_overlap(least, num, den)))
    classes = written(rows.where("n > 0 AND id IS NOT NULL").groupBy("a", "b", "n").agg(F.min("id").alias("id")), "classes")
    met = written(banded(listed(texts.where("id IS NOT NULL AND text IS NOT NULL"), classes, k, num, den, weight, shared), num, den), "lists")
    released(df.sparkSession)
    own = ["id", "band"]  # sets under fewer than ``shared`` keys with company cannot share that many
    busy, (small, large) = lengths(met), useful(shared)
    rich = busy.groupBy(*own).agg((small | large).alias("rich")).where("rich").select(*own)
    had, met = met, written(busy.join(rich, own).select("key", "band", "id", "n", "core"), "lists")
    dropped(had)
    met = lengths(met)
    had, met = met, written(met.join(met.groupBy(*own).agg(F.count(F.lit(1)).cast("int").alias("q")), own).select("key", "band", "id", "n", "core", "q", "f", "cores"), "lists")
    dropped(had)
    boundary = boundary_by_cost(met, shared)
    # lists serve pairs with a large set: only keys that have one
    large = met.groupBy("key").agg(F.max("q").alias("most")).where(F.col("most") > boundary).select("key")
    wide = written(met.join(large, "key"), "wide")
    small = written(lengths(subset_keys(met.where(F.col("q") <= boundary), shared)), "subsets")
    hot = wide.select("key", "id", "n", "cores").unionByName(small.select("key", "id", "n", "cores")).where(F.col("cores") >= HOT)
    hot = written(hot.select("key", "id", "n"), "hot")
    sets = collected(texts, written(met.select("id").distinct(), "ids"), k)
    dropped(met)
    released(df.sparkSession)

    links, label = hub_links(hot, sets, num, den)
    light = light_pairs(wide.where(F.col("cores") < HOT), label, num, den, shared, boundary).unionByName(light_pairs(small.where(F.col("cores") < HOT), label, num, den, 1, 0))
    light = written(at_home(written(light.groupBy("a", "b").agg(F.max("n_b").alias("n_b")), "light")), "light")
    for table in (wide, small):
        dropped(table)
    released(df.sparkSession)
    links = links.unionByName(verified(light, sets, num, den).where("link").select("a", "b"))
    label = written(components(links), "labels")
    dropped(sets)
    released(df.sparkSession)

    named = classes.join(label.withColumnRenamed("node", "id"), "id", "left").select("a", "b", F.col("n").alias("_n"), F.coalesce("component", "id").alias("component"))
    out = rows.join(named, (rows["a"] == named["a"]) & (rows["b"] == named["b"]) & (rows["n"] == named["_n"]), "left")
    return out.select(rows["id"].alias(id_col), rows["n"].alias("n_shingles"), F.when(rows["id"].isNotNull(), F.coalesce("component", rows["id"])).alias("component_id"))
