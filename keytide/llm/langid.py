"""Language identification with error-correcting output codes.

Every learned language has a codeword; for each bit a linear n-gram classifier tells the languages whose codeword
has it set from the others. A text's bits are margins (mean log ratios of its byte trigrams, so length does not
matter), and loss-weighted decoding takes the codeword with the least exponential loss, each bit weighted by how well
its classifier separates that language on the training counts. A text whose best two codewords are close is flagged.

Training is one pass: trigram counts by language over all training rows, summed on the executors; what reaches the
driver is one count per language and trigram bucket (``BUCKETS``), whatever the size of the input.

Defined results: ``und`` with score 0 for a null text, a text without letters, or when nothing could be learned; with
one learned language every text with letters gets it. Rows with null lang are not learned from; repeated rows count
and are predicted each time. Ties go to the language that sorts first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches, trimmed
from .words import Texts, slices

BUCKETS = 1 << 13
#: Codewords: all splits of the languages up to EXHAUSTIVE of them, else a seeded random code of BITS_PER bits a doubling.
EXHAUSTIVE, BITS_PER, SEED = 6, 12, 11
#: Score below which a prediction counts as ambiguous.
AMBIGUOUS = 0.05

_FOLD = np.full(256, 0x20, np.uint32)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def trigrams(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the folded byte trigram at each position that has one with a letter, and its text's number."""
    b = _FOLD[t.data]
    if b.size < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    own = np.repeat(np.arange(t.rows), np.diff(t.at))
    ok = np.flatnonzero((own[:-2] == own[2:]) & (b[1:-1] != 0x20))
    key = key[ok] * np.uint32(0x9E3779B1)
    return ((key ^ (key >> np.uint32(15))) % np.uint32(BUCKETS)).astype(np.int64), own[ok]


def training_counts(df: DataFrame, text_col: str, lang_col: str) -> pd.DataFrame:
    """(lang, bucket, n) over all rows of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = batch.column(1)
            for t in slices(batch.column(0)):
                names, code = np.unique(np.array(lang.slice(t.first, t.rows).to_pylist(), object).astype(str), return_inverse=True)
                bucket, own = trigrams(t)
                got = np.bincount(code[own] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for name, row in zip(names, got):
                    total[name] = total[name] + row if name in total else row
        for name, row in total.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(row[at], pa.int64())], names=["lang", "bucket", "n"])

    parts = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return parts.mapInArrow(trimmed(run), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1, no column constant, no column twice or as another's opposite."""
    if k < 2:
        return np.ones((k, 0))
    if k <= EXHAUSTIVE:
        return np.array([[1 if i == 0 or (c >> (i - 1)) & 1 else -1 for c in range(2 ** (k - 1) - 1)] for i in range(k)], float)
    rng = np.random.default_rng(SEED)
    bits = math.ceil(BITS_PER * math.log2(k))
    best, far = None, -1
    for _ in range(64):
        m = rng.choice([-1.0, 1.0], (k, bits))
        m = m[:, np.abs(m.sum(axis=1 - 1)) < k]
        apart = int(((m[:, None, :] != m[None, :, :]).sum(axis=2) + np.eye(k) * bits * 2).min())
        if apart > far:
            best, far = m, apart
    return best


class Model:
    """Classifier weights of each bit, codewords and decoding weights."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        k = len(self.langs)
        freq = np.zeros((k, BUCKETS))
        freq[counts["lang"].map({x: i for i, x in enumerate(self.langs)}).to_numpy(int), counts["bucket"].to_numpy(int)] = counts["n"].to_numpy(float)
        freq = (freq + 0.5) / (freq.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
        self.code = codewords(k)
        one, other = self.code == 1, self.code == -1
        mean = lambda side: (side.T.astype(float) @ freq) / np.maximum(side.sum(axis=0), 1)[:, None]
        self.weights = np.log(mean(one) / mean(other)).astype(np.float32)  # bits x buckets
        margin = (freq @ self.weights.T) * self.code  # how well each bit's classifier knows each language
        self.scale = 1.0 / np.maximum(np.abs(margin).mean(axis=0), 1e-6) if k > 1 else np.ones(0)
        good = np.maximum(margin, 1e-6)
        self.decoding = good / good.sum(axis=1, keepdims=True) if k > 1 else np.ones((k, 0))

    def predict(self, t: Texts) -> tuple[list[str], np.ndarray]:
        k = len(self.langs)
        letters = np.array([not t.null[i] and any(c.isalpha() for c in t.text(i).decode()) for i in range(t.rows)], bool)
        if not k:
            return ["und"] * t.rows, np.zeros(t.rows)
        if k == 1:
            return [self.langs[0] if x else "und" for x in letters], letters.astype(float)
        bucket, own = trigrams(t)
        n = np.maximum(np.bincount(own, minlength=t.rows), 1)
        margin = np.stack([np.bincount(own, weights=w[bucket], minlength=t.rows) / n for w in self.weights], axis=1) * self.scale
        loss = np.zeros((t.rows, k))
        for i in range(k):
            loss[:, i] = np.exp(-np.clip(margin * self.code[i], -30, 30)) @ self.decoding[i]
        order = np.argsort(loss, axis=1, kind="stable")
        every = np.arange(t.rows)
        first, second = loss[every, order[:, 0]], loss[every, order[:, 1]]
        score = np.where(letters, np.clip(1.0 - first / np.maximum(second, 1e-300), 0.0, 1.0), 0.0)
        return [self.langs[j] if x else "und" for j, x in zip(order[:, 0], letters)], score


def learned(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    return Model(training_counts(df, text_col, lang_col))


def predicted(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, lang_pred, score and ambiguous of every row; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in slices(batch.column(1), 1 << 20):
                lang, score = model.predict(t)
                cols = [batch.column(0).slice(t.first, t.rows), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(score < AMBIGUOUS)]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "lang_pred", "score", "ambiguous"])

    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(run), f"`{id_col}` {kind}, lang_pred string, score double, ambiguous boolean")


def fold(id_col: str = "doc_id") -> Column:
    """The fold of a row: crc32 of the id as text, mod 3 (null ids as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3
