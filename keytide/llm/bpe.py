"""Byte-level BPE encoding and decoding with batched numpy merge rounds.

The texts of a batch are cut into pieces by the tokenizer's pattern. All pieces not met before are encoded at
once: their byte symbols lie in one flat array; in every round the keys of all neighbouring pairs are looked up
by binary search in the sorted table of merges, each piece merges every place of its lowest-ranked pair, and
pieces without a pair that merges leave the array. Pieces met before come from a cache of bounded size. Pieces above
``LONG`` bytes (a text without spaces is one) merge rank by rank instead: a round merges all places of the lowest rank
of all such pieces and looks up only the pairs beside them, so that a long piece costs no rescan of itself.

Defined results: a null text counts as empty; an empty text has no ids and decodes to an empty text. Repeated
rows give repeated rows. Of the input only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches, trimmed
from .words import slices

#: The pattern of the byte-level pre-tokenizer and its special token's text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as the pre-tokenizer knows it (Unicode White_Space); stated, since libraries differ on 0x1C-0x1F.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pieces that a worker remembers.
CACHE_PIECES = 150_000
#: Bytes of text handled at a time; bytes from which a piece merges rank by rank.
SLICE, LONG = 2 << 20, 512


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def piece_pattern() -> regex.Pattern:
    return regex.compile(PATTERN.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))


class Bpe:
    """A byte-level BPE tokenizer read from a tokenizer.json file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError(f"{path} is not a byte-level BPE tokenizer")
        odd = [x for x in ("ignore_merges", "byte_fallback", "fuse_unk", "dropout", "continuing_subword_prefix", "end_of_word_suffix") if model.get(x)]
        odd += [x for x in ("add_prefix_space",) if spec["pre_tokenizer"].get(x)] + [x for t in spec.get("added_tokens", []) for x in ("lstrip", "rstrip", "single_word") if t.get(x)]
        if odd or not spec["pre_tokenizer"].get("use_regex", True):
            raise ValueError(f"{path} asks for what is not built: {', '.join(odd) or 'no pattern'}")
        vocab = model["vocab"]
        letter = byte_letters()
        byte_of = {c: b for b, c in enumerate(letter)}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.split = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.first = np.array([vocab[c] for c in letter], np.int64)
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()}
        self.bytes_of |= {i: content.encode() for content, i in self.special.items()}
        left, right, made = [], [], []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left.append(vocab[a])
            right.append(vocab[b])
            made.append(vocab[a + b])
        keys = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order, np.array(made, np.int64)
        self.pattern = piece_pattern()

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank at which each pair merges; the number of merges if it does not."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], len(self.keys))

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each piece has."""
        size = np.array([len(p) for p in pieces], np.int64)
        long = size > LONG
        if not long.any():
            return self.merged_short(pieces)
        count = np.zeros(len(pieces), np.int64)
        short_ids, count[~long] = self.merged_short([p for p, x in zip(pieces, long.tolist()) if not x])
        long_ids, count[long] = self.merged_long([p for p, x in zip(pieces, long.tolist()) if x])
        of_long = np.repeat(long, count)
        out = np.empty(of_long.size, np.int64)
        out[of_long], out[~of_long] = long_ids, short_ids
        return out, count

    def merged_long(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """merged() by rounds over ranks; symbols are linked, so that a merge touches its neighbours only."""
        never = len(self.keys)
        size = np.array([len(p) for p in pieces], np.int64)
        sym = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        n = sym.size
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        last = np.cumsum(size) - 1
        after[last], before[last - size + 1] = n, -1
        rank, live, waiting, queue = np.full(n, never), np.ones(n, bool), {}, []

        def look_up(at: np.ndarray) -> None:
            rank[at] = never
            at = at[after[at] < n]
            rank[at] = self.ranked(sym[at], sym[after[at]])
            at = at[rank[at] < never]
            at = at[np.argsort(rank[at], kind="stable")]
            edge = np.flatnonzero(np.diff(rank[at], prepend=-1)) if at.size else np.zeros(0, np.int64)
            for part in np.split(at, edge[1:]) if at.size else ():
                r = int(rank[part[0]])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(queue, r)
                waiting[r].append(part)

        look_up(np.arange(n))
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not at.size:
                continue
            # of a run of overlapping places every second one merges, from the left
            head = np.concatenate([[True], after[at[:-1]] != at[1:]])
            every = np.arange(at.size)
            at = at[(every - np.maximum.accumulate(np.where(head, every, 0))) % 2 == 0]
            gone = after[at]
            sym[at], live[gone], rank[gone], after[at] = self.made[r], False, never, after[gone]
            follows = after[at] < n
            before[after[at[follows]]] = at[follows]
            look_up(np.unique(np.concatenate([at, before[at][before[at] >= 0]])))
        own = np.repeat(np.arange(len(pieces)), size)[live]
        return sym[live], np.bincount(own, minlength=len(pieces))

    def merged_short(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """merged() by rounds over all pieces, each merging its lowest rank."""
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        never = len(self.keys)
        size = np.array([len(p) for p in pieces], np.int64)
        sym = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        own = np.repeat(np.arange(len(pieces)), size)
        done_sym, done_own = [], []
        while sym.size:
            rank = np.where(own[:-1] == own[1:], self.ranked(sym[:-1], sym[1:]), never)
            start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            best = np.minimum.reduceat(np.concatenate([rank, [never]]), start)
            length = np.diff(np.concatenate([start, [sym.size]]))
            lowest = np.repeat(best, length)
            live = lowest < never
            if not live.all():
                done_sym.append(sym[~live])
                done_own.append(own[~live])
            here = np.flatnonzero((rank == lowest[:-1]) & (rank < never))
            if here.size:
                # a run of overlapping places (as in "aaaa") merges every second one, from the left
                head = np.concatenate([[True], np.diff(here) != 1])
                since = np.arange(here.size) - np.maximum.accumulate(np.where(head, np.arange(here.size), 0))
                here = here[since % 2 == 0]
                sym[here] = self.made[rank[here]]
                live[here + 1] = False
            sym, own = sym[live], own[live]
        sym, own = np.concatenate(done_sym), np.concatenate(done_own)
        order = np.argsort(own, kind="stable")
        return sym[order], np.bincount(own, minlength=len(pieces))

    def pieces(self, text: str) -> list[str]:
        if self.split is None or not any(x in text for x in self.special):
            return self.pattern.findall(text)
        out: list[str] = []
        for i, part in enumerate(self.split.split(text)):
            out += [part] if i % 2 else self.pattern.findall(part)
        return out

    def decode(self, ids: np.ndarray) -> str:
        get = self.bytes_of
        return b"".join([get[i] for i in ids.tolist()]).decode("utf-8", "replace")


class Encoder:
    """Encodes texts batch by batch, remembering pieces up to a bound."""

    def __init__(self, bpe: Bpe, most: int = CACHE_PIECES):
        self.bpe, self.most = bpe, most
        self.clear()

    def clear(self) -> None:
        self.number = {c: i for i, c in enumerate(self.bpe.special)}
        self.flat = np.array(list(self.bpe.special.values()), np.int64)
        self.count = np.ones(len(self.number), np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids start and end."""
        cut = [self.bpe.pieces(t) for t in texts]
        if len(self.number) > self.most:
            self.clear()
        new = sorted(set().union(*cut) - self.number.keys())
        if new:
            ids, count = self.bpe.merged([p.encode() for p in new])
            base = len(self.number)
            self.number.update({p: base + i for i, p in enumerate(new)})
            self.flat = np.concatenate([self.flat, ids])
            self.count = np.concatenate([self.count, count])
        total = sum(map(len, cut))
        get = self.number.__getitem__
        piece = np.fromiter((i for x in cut for i in map(get, x)), np.int64, total)
        size = self.count[piece]
        begin = (np.cumsum(self.count) - self.count)[piece]
        end = np.cumsum(size)
        ids = self.flat[np.arange(end[-1] if total else 0) + np.repeat(begin - (end - size), size)]
        bound = np.concatenate([[0], np.cumsum([len(x) for x in cut])])
        return ids, np.concatenate([[0], end])[bound]


def encoded(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """One row per row: the id, ``ids`` (array of int) and, if asked for, ``decoded`` (their text).

    ``path`` is the tokenizer.json on every executor. No shuffle; memory is bounded by a slice of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(path)
        worker = Encoder(bpe)
        for batch in batches:
            for t in slices(batch.column(1), SLICE):
                texts = [t.text(i).decode() for i in range(t.rows)]
                ids, at = worker.encode(texts)
                cols = [batch.column(0).slice(t.first, t.rows), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))]
                if decode:
                    cols.append(pa.array([bpe.decode(ids[at[i] : at[i + 1]]) for i in range(t.rows)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    small_batches(df.sparkSession)
    names = [id_col, "ids"] + ["decoded"] * decode
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, ids array<int>" + ", decoded string" * decode
    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(run), schema)


def digests(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the op9 query from what encoded() returns."""
    return tokens.select(
        F.col(id_col),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
