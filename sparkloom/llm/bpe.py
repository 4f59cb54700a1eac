"""Byte-level BPE encoding and decoding over padded numpy matrices.

Words (the matches of the public pattern) are sorted into buckets by length and
each bucket becomes a matrix of token ids, padded at the right. In every round
each row merges its leftmost pair of least rank: pair ranks come from a hash
table of arrays, one column closes up in every row, and rows without a pair
left are taken out. A word of more than 1,024 bytes merges in the same order with
its pairs in a heap.

Each distinct piece of a text is encoded once and kept in a bounded table.

Defined results: a null text counts as empty and has no tokens; repeated rows
get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrow_text import text_slices
from sparkloom.llm.chunks import PieceTable

NONE = np.int32(2**31 - 1)
#: Widths of the buckets. A row's work grows with the square of its width, so longer words, which hardly
#: any script has between marks and spaces, are merged one by one in a heap.
WIDTHS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024)
#: Bytes that the table of pieces holds at most, about.
TABLE = 144 << 20
#: Rows and places that a matrix has at most.
ROWS, PLACES = 1 << 14, 1 << 20


class PairTable:
    """(left id, right id) -> merged id, by open addressing in two arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        self.steps = 1
        keys = np.array([(a << 32) | b for a, b in pairs] or [0], np.int64)[: len(pairs)]
        for key, home, value in zip(keys.tolist(), self.home(keys).tolist(), pairs.values(), strict=True):
            step = 1
            while self.keys[home] >= 0:
                home, step = (home + 1) & ((1 << self.bits) - 1), step + 1
            self.keys[home], self.values[home], self.steps = key, value, max(self.steps, step)

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where there is no merge or an id is negative."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = self.home(keys)
        out = np.where(self.keys[at] == keys, self.values[at], NONE)
        for step in range(1, self.steps):
            probe = (at + step) & ((1 << self.bits) - 1)
            out = np.where(self.keys[probe] == keys, self.values[probe], out)
        return np.where((left < 0) | (right < 0), NONE, out)


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words = regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.parts = parts = {(ranks[t[:k]], ranks[t[k:]]): i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.pairs = PairTable(parts)
        self.table = PieceTable(self.pieces, most=TABLE)

    def pieces(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes each, little-endian."""
        split = [self.words.findall(t) for t in texts]
        found = dict.fromkeys(w for s in split for w in s)
        found.update(zip(found, self.encode_words([w.encode() for w in found]), strict=True))
        return [b"".join(map(found.__getitem__, s)) for s in split]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        size = np.array([len(w) for w in words], np.int64)
        out: list[bytes] = [b""] * len(words)
        low = 0
        for width in WIDTHS:
            rows = np.flatnonzero((size > low) & (size <= width))
            step = min(ROWS, PLACES // width)
            for k in range(0, len(rows), step):
                some = rows[k : k + step]
                for r, ids in zip(some.tolist(), self.merge([words[i] for i in some], width), strict=True):
                    out[r] = ids
            low = width
        for r in np.flatnonzero(size > WIDTHS[-1]).tolist():
            out[r] = self.merge_long(words[r])
        return out

    def merge(self, words: list[bytes], width: int) -> list[bytes]:
        """Words of one bucket."""
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        size = np.array([len(w) for w in words])
        ids = np.where(np.arange(width) < size[:, None], self.single[raw], np.int32(-1))
        rank = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
        row = np.arange(len(words))
        out: list[bytes] = [b""] * len(words)

        def done(which: np.ndarray) -> None:
            for r, x in zip(row[which].tolist(), ids[which], strict=True):
                out[r] = x[x >= 0].astype("<u4").tobytes()

        while len(row):
            at = rank.argmin(1)
            best = rank[np.arange(len(row)), at]
            going = best < NONE
            if not going.all():
                done(~going)
                ids, rank, row, at, best = ids[going], rank[going], row[going], at[going], best[going]
            if not len(row):
                break
            n, w = ids.shape
            every = np.arange(n)
            ids[every, at] = best
            keep = np.ones((n, w), bool)
            keep[every, at + 1] = False
            ids = ids[keep].reshape(n, w - 1)
            if w == 2:
                done(np.ones(n, bool))
                break
            rank = rank[keep[:, 1:]].reshape(n, w - 2)
            right = np.minimum(at, w - 3)
            rank[every, right] = self.pairs.ranks(ids[every, right], ids[every, right + 1])
            left = np.maximum(at - 1, 0)
            rank[every, left] = self.pairs.ranks(ids[every, left], ids[every, left + 1])
        return out

    def merge_long(self, word: bytes) -> bytes:
        """One long word: its pairs in a heap by rank and place, its tokens in a linked list."""
        ids = self.single[np.frombuffer(word, np.uint8)]
        ranks = self.pairs.ranks(ids[:-1], ids[1:])
        heap = [(r, i) for i, r in enumerate(ranks.tolist()) if r < NONE]
        heapify(heap)
        ids, n = ids.tolist(), len(ids)
        after, before, rank_at = list(range(1, n + 1)), list(range(-1, n - 1)), [*ranks.tolist(), NONE]
        while heap:
            r, i = heappop(heap)
            if rank_at[i] != r:
                continue
            gone = after[i]
            ids[i], after[i], rank_at[gone] = r, after[gone], None
            ids[gone] = -1
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0:
                    rank_at[k] = self.parts.get((ids[k], ids[after[k]]), NONE) if after[k] < n else NONE
                    if rank_at[k] < NONE:
                        heappush(heap, (rank_at[k], k))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4") for x in self.table.joined(texts)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def texts_of(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, list[str]]]:
    for lo, hi, data, at in text_slices(batch, column):
        raw = data.tobytes()
        yield lo, hi, [raw[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of each text."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for lo, hi, texts in texts_of(batch, "text"):
                ids = [x.astype(np.int32) for x in c.encode(texts)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, ids array<int>")


def decoded(encodings: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) of (doc_id, ids). Null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            out = [c.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return encodings.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encodings.dtypes)['doc_id']}, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each text encoded and its ids decoded: doc_id, n_tokens, ids_sha256, decoded_sha256. The ids stay in the task."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for lo, hi, texts in texts_of(batch, "text"):
                ids = c.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([sha(",".join(map(c.text_of.__getitem__, x.tolist())).encode()) for x in ids], pa.string()),
                        pa.array([sha(c.decode(x)) for x in ids], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
