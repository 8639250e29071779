"""Vectorised words, hashes and n-gram hashes over Arrow text columns.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. Those bytes never occur inside a multi-byte
UTF-8 sequence, so the byte view gives the same words as the character view.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text handled at a time; a longer text is a slice of its own, always whole.
SLICE_BYTES = 1 << 19
#: Words longer than this are hashed one by one.
LONG_WORD = 512

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_MASK = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], dtype=np.uint64)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (public domain): a bijection on 64-bit values."""
    x = (x ^ (x >> _S30)) * _B
    x = (x ^ (x >> _S27)) * _C
    return x ^ (x >> _S31)


@dataclass
class Texts:
    """Some rows of a text column: their bytes one after another, and where each row starts and ends."""

    first: int
    rows: int
    data: np.ndarray
    at: np.ndarray
    null: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The column in runs of whole rows of about ``limit`` bytes; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    null = np.asarray(column.is_null())
    column = column.fill_null("").cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield Texts(lo, hi - lo, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], null[lo:hi])
        lo = hi


@dataclass
class Words:
    """Words of several texts: byte spans in order, and ``at[i]:at[i + 1]`` for those of text i."""

    start: np.ndarray
    end: np.ndarray
    at: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.counts())


def words(t: Texts, data: np.ndarray | None = None) -> Words:
    data = t.data if data is None else data
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    head, tail = t.at[:-1], t.at[1:] - 1
    head, tail = head[head < data.size], tail[tail >= 0]
    first[head], last[tail] = inside[head], inside[tail]
    start = np.flatnonzero(first)
    return Words(start, np.flatnonzero(last) + 1, np.searchsorted(start, t.at))


def word_hashes(data: np.ndarray, w: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes and length."""
    size = w.end - w.start
    h = mix(size.astype(np.uint64) * _A + np.uint64(seed))
    if not size.size:
        return h
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    part = eight[w.start].view(np.uint64).ravel() & _MASK[np.minimum(size, 8)]
    h = mix(h ^ (part * _A))
    more = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    at, left = w.start[more] + 8, size[more] - 8
    while more.size:
        part = eight[at].view(np.uint64).ravel() & _MASK[np.minimum(left, 8)]
        h[more] = mix(h[more] ^ (part * _A))
        on = left > 8
        more, at, left = more[on], at[on] + 8, left[on] - 8
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(data[w.start[i] : w.end[i]].tobytes(), seed)
    return h


def gram_hashes(h: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of the k-word runs that start at each position; len(h) - k + 1 of them, across texts too.

    Runs of 1, 2, 4, ... words are built by doubling, and those in k's binary form are put together.
    """
    n = max(0, h.size - k + 1)
    if not n:
        return np.zeros(0, np.uint64)
    times = lambda words: np.uint64(pow(base, words, 2**64))
    out, done, block, width = None, 0, h, 1
    while True:
        if k & width:
            out = block if out is None else out[: block.size - done] * times(width) + block[done:]
            done += width
        if 2 * width > k:
            break
        block = block[:-width] * times(width) + block[width:]
        width *= 2
    return mix(out[:n])


def within(w: Words, k: int) -> np.ndarray:
    """Which of the positions of gram_hashes() lie inside a single text."""
    n = max(0, w.start.size - k + 1)
    ok = np.ones(n, bool)
    for end in w.at[1:-1]:
        ok[max(0, end - k + 1) : end] = False
    return ok


def i64(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def sub_batches(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Each batch in parts of about SLICE_BYTES of text, with the rows that belong to the part."""
    for batch in batches:
        for t in slices(batch.column(batch.schema.get_field_index(text))):
            yield batch.slice(t.first, t.rows), t
