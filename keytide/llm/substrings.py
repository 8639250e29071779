"""Exact removal of word windows that a document with a smaller id has too.

A window is ``WINDOW`` consecutive words of one document. Its anchor is the least hash among the ``GRAM``-word runs
inside it, so equal windows have equal anchors and neighbouring windows share them; counts of anchors are upper bounds
of counts of windows. Three steps narrow the windows down, and none loses a repeated one:

1. Count-min prefilter: every partition builds a sketch of its documents' anchors (two rows of cells that tell none,
   one or more documents); the merged sketch overestimates the counts. It has ``PER_ANCHOR`` cells in a row for each anchor
   that the bytes of text let expect, up to ``MOST_CELLS`` (a broadcast of 16 MB): beyond about 2 GB of text it marks
   more and more anchors that are not repeated, which step 2 then sorts out (24 bytes for each, a tenth to a sixth of the text).
2. Anchors estimated as repeated are grouped exactly, as (anchor, document) rows.
3. Windows under exactly repeated anchors are grouped exactly by 128 bits (anchor and window hash). A task first settles all but the
   smallest document of each window among its own rows, so a window that very many documents share arrives once from
   each task.

Defined results: null text has no words and a text of fewer than WINDOW words no windows, so nothing is removed from
them. A row with null id comes after all others: it loses what numbered rows have and takes nothing from anyone.
Rows with equal ids never take windows from each other; repeated rows get equal results; an empty table gives no rows; a
text of any length is cut as a whole. Windows are told apart by 128 bits of hash, never by their words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .routing import bit_of, chosen, free_name, key_bits, marked
from .scratch import trimmed, written
from .words import Texts, Words, gram_hashes, i64, mix, slices, within, word_hashes, words

WINDOW, GRAM = 50, 8
#: The sketch's rows, cells in each of them for each expected anchor (one in so many bytes of text), and parts that it is sent in.
ROWS, PER_ANCHOR, LEAST_CELLS, MOST_CELLS, ANCHOR_BYTES, PARTS = 2, 4, 1 << 16, 1 << 26, 128, 16
#: Sketches that a task of the first level merges, about.
FAN_IN = 128
#: Windows that a task settles at a time, and that a group of anchors holds, about.
CHUNK = 1 << 20
#: Values of an anchor's hash by which anchors are grouped.
SPREAD = 1 << 20
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
LAST = np.iinfo(np.int64).max
KEY = ["id", "th"]


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each k neighbours: running minima from both ends of blocks of k."""
    n = x.size - k + 1
    if n <= 0:
        return x[:0]
    blocks = -(-x.size // k)
    padded = np.full(blocks * k, np.iinfo(x.dtype).max, x.dtype)
    padded[: x.size] = x
    grid = padded.reshape(blocks, k)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[k - 1 : k - 1 + n])


def anchors(h: np.ndarray, w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of a slice, and the anchor of each."""
    start = np.flatnonzero(within(w, window))
    return start, sliding_min(gram_hashes(h, gram), window - gram + 1)[start]


def distinct_by_text(own: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once."""
    if own.size:
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (own[1:] != own[:-1])])
        own, value = own[new], value[new]
        order = np.lexsort((value, own))
        own, value = own[order], value[order]
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (own[1:] != own[:-1])])
        own, value = own[new], value[new]
    return own, value


def cells_for(n_bytes: int) -> int:
    """Cells in a row of the sketch of so many bytes of text: a power of two."""
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << (PER_ANCHOR * n_bytes // ANCHOR_BYTES).bit_length()))


def cells(value: np.ndarray, row: int, size: int) -> np.ndarray:
    return (mix(value + np.uint64((row + 1) * BASES[1] % 2**64)) % np.uint64(size)).astype(np.int64)


class Sketch:
    """For each cell of all rows whether it was met at least once, and at least twice, as sorted cell numbers: a
    partition meets few of them. Merging is exact on those."""

    def __init__(self, size: int):
        self.size, self.one, self.two = size, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, value: np.ndarray) -> None:
        cell, n = np.unique(np.concatenate([cells(value, r, self.size) + r * self.size for r in range(ROWS)]), return_counts=True)
        self.two = np.union1d(self.two, np.concatenate([cell[n > 1], np.intersect1d(self.one, cell, assume_unique=True)]))
        self.one = np.union1d(self.one, cell)

    def parts(self) -> Iterator[tuple[int, bytes, bytes]]:
        """Cell numbers within each part; a few bytes for each cell that was met."""
        size = ROWS * self.size // PARTS
        for i in range(PARTS):
            one, two = (x[np.searchsorted(x, i * size) : np.searchsorted(x, (i + 1) * size)] - i * size for x in (self.one, self.two))
            yield i, one.astype(np.uint32).tobytes(), two.astype(np.uint32).tobytes()


def merged_sketch(texts: DataFrame, window: int, gram: int, size: int) -> np.ndarray:
    """Bits of the cells that more than one document met."""
    part_size = ROWS * size // PARTS

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, held, n = Sketch(size), [], 0
        for batch in batches:
            for t in slices(batch.column(0)):
                w = words(t)
                start, anchor = anchors(word_hashes(t.data, w), w, window, gram)
                held.append(distinct_by_text(w.owner()[start], anchor)[1])
                n += held[-1].size
                if n >= CHUNK:
                    sketch.add(np.concatenate(held))
                    held, n = [], 0
        if held:
            sketch.add(np.concatenate(held))
        got = list(zip(*sketch.parts()))
        yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.int32()), pa.array(got[1], pa.binary()), pa.array(got[2], pa.binary()), pa.array([False] * PARTS)], names=names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part, one, two, packed in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if part not in total:
                    total[part] = (np.zeros(part_size, bool), np.zeros(part_size, bool))
                had_one, had_two = total[part]
                if packed:
                    one, two = (np.unpackbits(np.frombuffer(zlib.decompress(x), np.uint8)).view(bool) for x in (one, two))
                    had_two |= two | (had_one & one)
                    had_one |= one
                else:
                    one, two = (np.frombuffer(x, np.uint32) for x in (one, two))
                    had_two[one[had_one[one]]] = True
                    had_two[two] = True
                    had_one[one] = True
        blob = lambda j: pa.array([zlib.compress(np.packbits(x[j]).tobytes(), 1) for x in total.values()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), blob(0), blob(1), pa.array([True] * len(total), pa.bool_())], names=names)

    names, schema = ["part", "one", "two", "packed"], "part int, one binary, two binary, packed boolean"
    built = texts.select("text").mapInArrow(trimmed(build), schema)
    sets = -(-built.rdd.getNumPartitions() // FAN_IN)
    if sets > 1:  # a first level, so that no task merges the sketches of very many others
        built = built.withColumn("set", F.spark_partition_id() % sets).repartition(PARTS * sets, "part", "set").drop("set").mapInArrow(trimmed(merge), schema)
    rows = built.repartition(PARTS, "part").mapInArrow(trimmed(merge), schema).select("part", "two").collect()
    bits = np.zeros(ROWS * size // 8, np.uint8)
    for r in rows:
        bits[r["part"] * part_size // 8 : (r["part"] + 1) * part_size // 8] |= np.frombuffer(zlib.decompress(bytes(r["two"])), np.uint8)
    return bits


def suspected(bits: np.ndarray, value: np.ndarray) -> np.ndarray:
    ok, size = np.ones(value.size, bool), bits.size * 8 // ROWS
    for r in range(ROWS):
        c = cells(value, r, size) + r * size
        ok &= (bits[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
    return ok


def repeated_anchors(texts: DataFrame, bits: np.ndarray, window: int, gram: int) -> DataFrame:
    """(id, th, anchors): for each row the anchors that other rows have too."""
    sent = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = sent.value
        for batch in batches:
            for t in slices(batch.column(2)):
                w = words(t)
                start, anchor = anchors(word_hashes(t.data, w), w, window, gram)
                own, anchor = distinct_by_text(w.owner()[start], anchor)
                ok = suspected(have, anchor)
                rows = pa.array(own[ok] + t.first)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(i64(anchor[ok]))], names=["id", "th", "anchor"])

    found = written(texts.select("id", "th", "text").mapInArrow(trimmed(run), "id long, th long, anchor long"), "anchors")
    who = F.struct("id", "th")
    again = found.groupBy("anchor").agg(F.min(who).alias("a"), F.max(who).alias("b")).where("NOT (a <=> b)").select("anchor")
    return written(found.join(again, "anchor").groupBy("id", "th").agg(F.collect_list("anchor").alias("anchors")), "anchored")


def blobs(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Binary values: the bytes of values[at[i]:at[i + 1]]."""
    raw = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * raw.dtype.itemsize).astype(np.int32)), pa.py_buffer(raw.tobytes())])


def bounds(n: int, new: np.ndarray) -> np.ndarray:
    """Where runs start (new[i]: entry i + 1 starts one), and the end."""
    return np.concatenate([np.zeros(min(n, 1), np.int64), np.flatnonzero(new) + 1, [n]])


def smallest(anchor: np.ndarray, hashed: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each window the smallest id among equal windows; two 64-bit hashes tell windows apart."""
    order = np.lexsort((ids, hashed, anchor))
    x, y = anchor[order], hashed[order]
    at = bounds(ids.size, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
    out = np.empty(ids.size, np.int64)
    out[order] = np.repeat(ids[order][at[:-1]], np.diff(at))
    return out


def settled(texts: DataFrame, anchored: DataFrame, window: int, gram: int) -> DataFrame:
    """(id, th, runs): removed windows as pairs of int32 (first start, number), possibly in several rows for a text."""
    schema = "part int, id long, th long, anchor long, first int, number int, hash binary"
    names = ["part", "id", "th", "anchor", "first", "number", "hash"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        keys: list[tuple[int | None, int]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            anchor, hashed, row, pos = (np.concatenate(x) for x in zip(*held))
            ids = np.array([LAST if k[0] is None else k[0] for k in keys], np.int64)[row]
            stays = ids == smallest(anchor, hashed, ids)
            # runs of neighbouring windows under one anchor with the same lot
            new = (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (stays[1:] != stays[:-1])
            at = bounds(row.size, new)
            head = at[:-1]
            part = np.where(stays[head], (mix(anchor[head]) % np.uint64(SPREAD)).astype(np.int64), -1)
            size = np.where(stays[head], np.diff(at), 0)  # what is settled here needs no hashes
            sent = hashed[np.repeat(stays[head], np.diff(at))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part, pa.int32()), pa.array([keys[i][0] for i in row[head]], pa.int64()), pa.array([keys[i][1] for i in row[head]], pa.int64()), pa.array(i64(anchor[head])),
                    pa.array(pos[head], pa.int32()), pa.array(np.diff(at), pa.int32()), blobs(sent, np.concatenate([[0], np.cumsum(size)])),
                ],
                names=names,
            )
            held.clear()
            keys.clear()

        size = 0
        for batch in batches:
            for t in slices(batch.column(2)):
                w = words(t)
                h = word_hashes(t.data, w)
                start, anchor = anchors(h, w, window, gram)
                if start.size:
                    own = w.owner()[start]
                    lists = batch.column(3).slice(t.first, t.rows)
                    wanted = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                    at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
                    ok = np.zeros(start.size, bool)
                    edge = np.searchsorted(own, np.arange(t.rows + 1))
                    for i in range(t.rows):
                        here = slice(edge[i], edge[i + 1])
                        ok[here] = np.isin(anchor[here], wanted[at[i] : at[i + 1]])
                    start, own = start[ok], own[ok]
                    held.append((anchor[ok], gram_hashes(h, window, BASES[1])[start], own + len(keys), (start - w.at[own]).astype(np.int32)))
                    size += start.size
                    keys += zip(batch.column(0).slice(t.first, t.rows).to_pylist(), batch.column(1).slice(t.first, t.rows).to_pylist())
                if size >= CHUNK:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    def group(table: pa.Table) -> pa.Table:
        one = {c: table.column(c).combine_chunks() for c in ("id", "th", "anchor", "first", "number", "hash")}
        number = one["number"].to_numpy().astype(np.int64)
        hashed = np.frombuffer(b"".join(x.as_buffer() for x in one["hash"]), np.uint64)
        run = np.repeat(np.arange(number.size), number)
        pos = one["first"].to_numpy()[run] + np.arange(run.size) - (np.cumsum(number) - number)[run]
        ids = np.array([LAST if x is None else x for x in one["id"].to_pylist()], np.int64)[run]
        lost = ids > smallest(one["anchor"].to_numpy().view(np.uint64)[run], hashed, ids)
        run, pos = run[lost], pos[lost]
        at = bounds(run.size, (run[1:] != run[:-1]) | (pos[1:] != pos[:-1] + 1))
        head = pa.array(run[at[:-1]])
        return pa.table({"id": one["id"].take(head), "th": one["th"].take(head), "first": pa.array(pos[at[:-1]], pa.int32()), "number": pa.array(np.diff(at), pa.int32())})

    rows = chosen(texts, anchored, KEY).alias("x").join(anchored.alias("y"), F.col("x.id").eqNullSafe(F.col("y.id")) & (F.col("x.th") == F.col("y.th"))).select("x.id", "x.th", "x.text", "y.anchors")
    parts = written(rows.mapInArrow(trimmed(split), schema), "windows")
    windows = parts.where("part >= 0").agg(F.coalesce(F.sum("number"), F.lit(0))).first()[0]
    groups = max(8, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(windows) // CHUNK))
    far = parts.where("part >= 0").withColumn("part", F.col("part") % groups).groupBy("part").applyInArrow(group, "id long, th long, first int, number int")
    return parts.where("part < 0").select("id", "th", "first", "number").unionByName(far)


def removed_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, th, runs): for each row that loses words its removed windows (first start and number of neighbouring ones)."""
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = merged_sketch(texts, window, gram, cells_for(int(n_bytes)))
    anchored = repeated_anchors(texts, bits, window, gram)
    return settled(texts, anchored, window, gram).groupBy("id", "th").agg(F.collect_list(F.struct("first", "number")).alias("runs"))


def covered(n: int, runs: list[dict], window: int) -> np.ndarray:
    """Which of n words lie in a removed window."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, [r["first"] for r in runs], 1)
    np.add.at(edge, [r["first"] + r["number"] - 1 + window for r in runs], -1)
    return np.cumsum(edge)[:n] > 0


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, whole_rows: bool = False) -> DataFrame:
    """Every row with its words counted, those removed, the spans of removed words and the text that is kept.

    Returns id_col, n_words, n_removed, spans (word numbers, first to last) and kept (words joined by one space). With
    ``whole_rows`` instead the rows of df, in which a row that loses words has its kept words as text_col, and rows
    that lose all their words are left out. Only rows that lose words (and few others) are shuffled.
    """
    gone = written(removed_windows(df, id_col, text_col, window), "removed")
    bits = df.sparkSession.sparkContext.broadcast(key_bits(gone, KEY))
    names, schema = df.columns, df.schema
    own_id, own_th, own_bit, own_runs = (free_name(names, x) for x in ("_id", "_th", "_bit", "_runs"))
    keep = names if whole_rows else [id_col]
    rows = df.select(*[F.col(f"`{c}`") for c in keep if c != text_col], F.col(text_col).cast("string").alias(text_col), F.col(id_col).cast("long").alias(own_id), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias(own_th))
    rows = rows.withColumn(own_bit, bit_of([own_id, own_th], bits.value.size * 8))

    def judged(batch: pa.RecordBatch, runs) -> pa.RecordBatch:
        n, lost, spans, kept, stays = [], [], [], [], []
        for x, at in zip(batch.column(batch.schema.get_field_index(text_col)), runs):
            own = (x.as_py() or "").encode().split()
            out = covered(len(own), at, window) if at else np.zeros(len(own), bool)
            n.append(len(own))
            lost.append(int(out.sum()))
            edge = np.flatnonzero(np.diff(np.concatenate([[0], out.view(np.int8), [0]])))
            spans.append([{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2])])
            if whole_rows and not lost[-1]:
                kept.append(x.as_py())
            else:
                kept.append(b" ".join([w for w, o in zip(own, out.tolist()) if not o] if lost[-1] else own).decode())
            stays.append(not lost[-1] or lost[-1] < n[-1])
        if whole_rows:
            cols = [pa.array(kept, pa.string()) if c == text_col else batch.column(batch.schema.get_field_index(c)) for c in names]
            return pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(stays, pa.bool_()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array(kept, pa.string())], names=[id_col, "n_words", "n_removed", "spans", "kept"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                yield batch.slice(lo, 256)

    def is_marked(batch: pa.RecordBatch) -> np.ndarray:
        return marked(bits.value, batch.column(batch.schema.get_field_index(own_bit)))

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            batch = batch.filter(pa.array(~is_marked(batch)))
            yield judged(batch, [None] * batch.num_rows)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            yield judged(batch, batch.column(batch.schema.get_field_index(own_runs)).to_pylist())

    def to_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(is_marked(batch)))

    if whole_rows:
        result = ", ".join(f"`{f.name}` {'string' if f.name == text_col else f.dataType.simpleString()}" for f in schema)
    else:
        result = f"`{id_col}` {schema[id_col].dataType.simpleString()}, n_words long, n_removed long, spans array<struct<first: long, last: long>>, kept string"
    found = gone.select(F.col("id").alias("gone_id"), F.col("th").alias("gone_th"), F.col("runs").alias(own_runs)).alias("g")
    near = rows.mapInArrow(trimmed(to_join), rows.schema)
    far = near.alias("r").join(found, F.col(f"r.{own_id}").eqNullSafe(F.col("g.gone_id")) & (F.col(f"r.{own_th}") == F.col("g.gone_th")), "left").select("r.*", f"g.{own_runs}")
    return rows.mapInArrow(trimmed(untouched), result).unionByName(far.mapInArrow(trimmed(touched), result))
