"""Quality rules: rule statistics of every text, and an isolation forest that finds anomalous ones.

Statistics are exact and cover whole texts. The forest is fitted on a bounded sample of labelled rows
(``FOREST_ROWS``, those with the smallest hashes of doc_id that pass the base rules); the score of a row is the usual
2 ** (-mean path length / expected length). The rejection threshold is calibrated on all labelled rows, through a
histogram of scores by label: of the thresholds that reject at most ``MOST_GOOD_LOST`` of the good rows it takes
the one with the best balance of bad rows caught over good rows lost.

Defined results: a null or empty text has no words, zero statistics, fails the base rules and is not kept.
Labels that are null, repeated or without a document add nothing that matters: repeats count once per row. With
no labelled rows, or with labels of one kind only, the method rejects nothing and only the base rules count. Repeated
rows are judged alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .routing import marking
from .scratch import smallest_hashes, trimmed, written
from .words import SPACE, gram_hashes, i64, mix, slices, within, word_hashes, words

#: Most labelled rows that the forest is fitted on.
FOREST_ROWS = 8192
TREES, TREE_ROWS, SEED = 100, 256, 7
BINS = 1000
MOST_GOOD_LOST = 0.002

SYMBOL = np.zeros(256, np.uint8)
SYMBOL[list(b"#*$%&|<>")] = 1
UPPER = np.zeros(256, np.uint8)
UPPER[0x41:0x5B] = 1
DIGIT = np.zeros(256, np.uint8)
DIGIT[0x30:0x3A] = 1

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_distinct"]
#: The rules' limits: symbols a word, mean length of words, and shares of lines, words and characters.
RULES = {"symbols": 0.1, "long_words": 10.0, "short_words": -3.0, "dup_lines": 0.3, "repeats": 0.3, "upper": 0.3, "digits": 0.25, "few_distinct": -0.1}


def _sums(per_byte: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(per_byte, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def rule_counts(t) -> dict[str, np.ndarray]:
    """The statistics of each text of a slice."""
    w = words(t)
    h = word_hashes(t.data, w)
    n = w.counts()
    own = w.owner()
    out = {"n_words": n}
    out["word_chars"] = _sums(~SPACE[t.data] & ((t.data & 0xC0) != 0x80), t.at)
    out["n_symbols"] = _sums(SYMBOL[t.data], t.at)
    out["n_upper"] = _sums(UPPER[t.data], t.at)
    out["n_digits"] = _sums(DIGIT[t.data], t.at)
    lines, again = np.zeros(t.rows, np.int64), np.zeros(t.rows, np.int64)
    for i in range(t.rows):
        full = [x for x in t.text(i).split(b"\n") if x.strip()]
        lines[i], again[i] = len(full), len(full) - len(set(full))
    out["n_lines"], out["n_dup_lines"] = lines, again

    def repeated(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(key.size, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        return twice

    ok = np.flatnonzero(within(w, 3))
    grams = gram_hashes(h, 3)[ok]
    hit = ok[repeated(mix(grams + own[ok].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))]
    covered = np.zeros(h.size, bool)
    for j in range(3):
        covered[hit + j] = True
    out["n_repeat_words"] = np.bincount(own[covered], minlength=t.rows)
    key = np.unique(mix(h + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    out["n_distinct"] = np.bincount(own[key], minlength=t.rows)
    return out


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ids: DataFrame | None = None) -> DataFrame:
    """The id and COUNTS of every row, or of the rows with an id in ``ids`` and of few others; one pass, no shuffle."""
    rows, keep = df.select(F.col(id_col), F.col(text_col).cast("string").alias("text")), None
    if ids is not None:
        rows, keep = marking(rows, ids, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = keep(batch) if keep else batch
            for t in slices(batch.column(1)):
                got = rule_counts(t)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, t.rows)] + [pa.array(got[c], pa.int64()) for c in COUNTS], names=[id_col, *COUNTS])

    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(trimmed(run), f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def features(x: dict[str, np.ndarray]) -> np.ndarray:
    """The forest's view: by how much each ratio breaks its rule (0 where it keeps it), so that texts which break
    none are alike to the forest and only rule breakers can be isolated."""
    n, chars, lines = (np.maximum(x[c], 1) for c in ("n_words", "word_chars", "n_lines"))
    length = x["word_chars"] / n
    ratios = {
        "symbols": x["n_symbols"] / n, "long_words": length, "short_words": -length, "dup_lines": x["n_dup_lines"] / lines,
        "repeats": x["n_repeat_words"] / n, "upper": x["n_upper"] / chars, "digits": x["n_digits"] / chars, "few_distinct": -x["n_distinct"] / n,
    }
    return np.stack([np.maximum(ratios[name] - limit, 0.0) for name, limit in RULES.items()], axis=1)


def expected_path(n: float) -> float:
    """The mean path of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class Forest:
    """An isolation forest with trees as flat arrays."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, size: int = TREE_ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        size = min(size, len(rows))
        self.norm = max(expected_path(size), 1e-9)
        self.depth = max(1, math.ceil(math.log2(max(size, 2))))
        self.trees = [self._grown(rows[rng.choice(len(rows), size, replace=False)], rng) for _ in range(trees)]

    def _grown(self, rows: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        col, cut, left, right, path = [], [], [], [], []

        def node(part: np.ndarray, depth: int) -> int:
            at = len(col)
            for x in (col, cut, left, right):
                x.append(0)
            path.append(depth + expected_path(len(part)))
            low, high = part.min(axis=0), part.max(axis=0)
            can = np.flatnonzero(high > low)
            if depth < self.depth and len(part) > 1 and can.size:
                c = int(rng.choice(can))
                v = float(rng.uniform(low[c], high[c]))
                go = part[:, c] < v
                if go.any() and not go.all():
                    col[at], cut[at] = c, v
                    left[at], right[at] = node(part[go], depth + 1), node(part[~go], depth + 1)
                    return at
            left[at] = right[at] = at
            return at

        node(rows, 0)
        return np.array(col), np.array(cut, float), np.array(left), np.array(right), np.array(path)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for col, cut, left, right, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                at = np.where(rows[every, col[at]] < cut[at], left[at], right[at])
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / self.norm)


def threshold(good: np.ndarray, bad: np.ndarray, most_lost: float = MOST_GOOD_LOST) -> float:
    """The score from which rows are rejected; above 1 (nothing) unless labels speak for a cut.

    good and bad are histograms of labelled rows over BINS equal parts of the scores.
    """
    if not good.sum() or not bad.sum():
        return 2.0
    lost = np.cumsum(good[::-1])[::-1] / good.sum()
    caught = np.cumsum(bad[::-1])[::-1] / bad.sum()
    gain = np.where(lost <= most_lost, caught - lost, -1.0)
    best = int(np.argmax(gain))
    return best / len(good) if gain[best] > 0 else 2.0


def base_failed(n_words, n_repeat_words):
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def scored(df: DataFrame, forest: Forest) -> DataFrame:
    """df (with COUNTS) and the forest's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = features({c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in COUNTS})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.scores(rows), pa.float64())], names=[*batch.schema.names, "score"])

    return df.mapInArrow(trimmed(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", score double")


def fitted(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> tuple[Forest | None, float]:
    """The forest and the score from which it rejects; no forest without labelled rows."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_q"))
    passing = stats.where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    labelled = passing.join(known, F.col(id_col) == F.col("_id")).select(id_col, *COUNTS, "_q")
    labelled = written(labelled, "labelled")
    sample = smallest_hashes(labelled.drop("_q"), F.xxhash64(id_col), FOREST_ROWS, labelled.count()).select(*COUNTS).toPandas()
    if not len(sample):
        return None, 2.0
    forest = Forest(features({c: sample[c].to_numpy() for c in COUNTS}))
    place = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int")
    bins = scored(labelled, forest).groupBy(place.alias("bin")).agg(F.sum((F.col("_q") == 1).cast("long")).alias("good"), F.sum((F.col("_q") != 1).cast("long")).alias("bad")).toPandas()
    good, bad = np.zeros(BINS), np.zeros(BINS)
    good[bins["bin"]], bad[bins["bin"]] = bins["good"], bins["bad"]
    return forest, threshold(good, bad)


def quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The statistics of every row of ``df`` with base_failed, score and kept."""
    stats = written(statistics(df, id_col, text_col), "rule-stats")
    forest, cut = fitted(stats, labels, id_col)
    out = stats.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    out = scored(out, forest) if forest else out.withColumn("score", F.lit(0.0))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") < cut))


def passing(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that quality() keeps, each judged by its own text, without a shuffle; a first pass fits on labelled rows only."""
    known = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").cast(df.schema[id_col].dataType).alias(id_col)).where(F.col(id_col).isNotNull())
    forest, cut = fitted(statistics(df, id_col, text_col, known), labels, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in slices(batch.column(batch.schema.get_field_index(text_col))):
                got = rule_counts(t)
                keep = ~base_failed(got["n_words"], got["n_repeat_words"])
                if forest:
                    keep &= forest.scores(features(got)) < cut
                yield batch.slice(t.first, t.rows).filter(pa.array(keep))

    return df.mapInArrow(trimmed(run), df.schema)
