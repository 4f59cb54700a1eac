"""Packing documents into training sequences by order-preserving dynamic programming.

Every partition is a stream of tokens in the order of its rows. Where sequences
end is chosen among the ends of documents and sentences; a stretch without such
an end offers a place every ``STRIDE`` tokens. The cost of a sequence is its
padding plus a penalty for the place at which it ends: none for a document's
end, some for a sentence's, more elsewhere. As the padding is the window less a
difference of positions, the best predecessor of a place is the least of
cost + position within one window behind it, which a monotone queue gives in
constant time.

A stream is settled block by block: the last few windows of a block are carried
into the next one, so memory is bounded for any partition and any document. In
a stream's last window every token may end a sequence and sequences as long as
a power of two, which need no padding, are considered too.

Nothing is shuffled: a lost task packs its own partition again, with the same
result. Sequence ids count up within a partition from partition * 2**33.

Defined results: a null text counts as empty and has only the end token; the
string of a special token in a text becomes that token, as in ``tokenizers``;
repeated rows are packed each; an empty table gives no pieces; other columns
are not read.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrow_text import text_slices
from sparkloom.llm.chunks import PieceTable

WINDOW = 2048
END_ID = 1
SENTENCE_COST, INSIDE_COST = 2.0, 12.0
STRIDE = 32
BLOCK, CARRIED = 1 << 18, 8 * WINDOW


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the names of byte-level tokens: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a byte-level tokenizer file, as ``tokenizers`` gives them with add_special_tokens=False.

    Where the file's merges come in the order of their ids, they are carried out
    by ``tiktoken``, which gives the same ids (the tests compare them) in a tenth
    of the time; else by ``tokenizers``. So are texts that hold the string of a
    special token, which becomes that token.

    ``ends``: ids after which a sentence may end; ``spaces``: ids that begin with white space.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        self.special = [v.content for v in t.get_added_tokens_decoder().values()]
        names = t.get_vocab(with_added_tokens=False)
        most = max([*names.values(), *t.get_added_tokens_decoder()])
        self.ends, self.spaces = np.zeros(most + 1, bool), np.zeros(most + 1, bool)
        for name, i in names.items():
            # in byte-level names these two letters stand for a space and a line feed
            self.ends[i], self.spaces[i] = name[-1:] in ".!?" or "Ċ" in name, name[:1] in "ĠĊ"

        with open(path, encoding="utf-8") as f:
            kept = json.load(f)
        merges = [m if isinstance(m, list) else m.split(" ") for m in kept["model"]["merges"]]
        order, letters = [names["".join(m)] for m in merges], byte_letters()
        plain = {n: i for n, i in names.items() if n not in self.special}
        if order == sorted(order) and kept.get("normalizer") is None and all(set(n) <= letters.keys() for n in plain):
            ranks = {bytes(letters[c] for c in n): i for n, i in plain.items()}
            fast = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            # faster than to look up its pieces in a table
            self.plain = lambda texts: [np.array(fast.encode_ordinary(t), "<u4").tobytes() for t in texts]
        else:
            self.plain = PieceTable(self.whole).joined

    def whole(self, texts: list[str]) -> list[bytes]:
        """By ``tokenizers``, each text as it is."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes each, little-endian."""
        out = self.plain(texts)
        marked = [k for k, t in enumerate(texts) if any(s in t for s in self.special)]
        for k, ids in zip(marked, self.whole([texts[k] for k in marked]), strict=True):
            out[k] = ids
        return out


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(places: list[int], costs: list[float], window: int = WINDOW, even_from: int | None = None) -> list[int]:
    """The cheapest ends of sequences over a stream whose last place is its end.

    ``places`` ascend, no two further apart than the window; the stream begins
    at 0. From ``even_from`` on, a sequence of a power of two needs no padding.
    """
    best, back, at = [0.0], [0], [0]
    queue, where = deque([(0.0, 0, 0)]), {0: 0}
    powers = [1 << k for k in range(window.bit_length() - 1)] if even_from is not None else []
    for place, cost in zip(places, costs, strict=True):
        while queue[0][1] < place - window:
            queue.popleft()
        least, _, source = queue[0]
        total = least + window - place + cost
        if powers and place >= even_from:
            for p in powers:
                i = where.get(place - p)
                if i is not None and best[i] + cost < total:
                    total, source = best[i] + cost, i
        j = len(at)
        best.append(total)
        back.append(source)
        at.append(place)
        where[place] = j
        while queue and queue[-1][0] >= total + place:
            queue.pop()
        queue.append((total + place, place, j))
    out, j = [], len(at) - 1
    while j:
        out.append(at[j])
        j = back[j]
    return out[::-1]


class Stream:
    """The tokens of one partition that aren't packed yet."""

    def __init__(self, ends: np.ndarray, spaces: np.ndarray, first_sequence: int, window: int):
        self.ends, self.spaces, self.sequence, self.window = ends, spaces, first_sequence, window
        self.parts: list[np.ndarray] = []
        self.keys: list = []  # documents that have tokens here, each with its length, and how much of it is packed
        self.totals: list[int] = []
        self.begun = 0
        self.size = 0

    def add(self, key, ids: np.ndarray) -> Iterator[dict]:
        self.parts.append(ids)
        self.keys.append(key)
        self.totals.append(len(ids))
        self.size += len(ids)
        while self.size >= BLOCK:
            yield self.settle(False)

    def places(self, ids: np.ndarray, last: np.ndarray, final: bool) -> tuple[np.ndarray, np.ndarray]:
        cost = np.full(len(ids) + 1, np.inf)
        sentence = self.ends[ids[:-1]] & self.spaces[ids[1:]]
        cost[1:-1][sentence] = SENTENCE_COST
        cost[last] = 0.0
        cost[0], cost[-1] = 0.0, min(cost[-1], INSIDE_COST)
        known = np.flatnonzero(cost < np.inf)
        gap = np.flatnonzero(np.diff(known) > STRIDE)
        for g in gap:
            inside = np.arange(known[g] + STRIDE, known[g + 1], STRIDE)
            cost[inside] = INSIDE_COST
        if final:
            tail = cost[max(1, len(ids) - self.window) :]
            tail[tail == np.inf] = INSIDE_COST
        at = np.flatnonzero(cost < np.inf)[1:]
        return at, cost[at]

    def settle(self, final: bool) -> dict:
        """Pack what is here, but for the last windows unless this is the end."""
        all_ids = np.concatenate(self.parts) if len(self.parts) > 1 else self.parts[0]
        ids = all_ids if final else all_ids[:BLOCK]
        begin = np.concatenate(([0], np.cumsum([t for t in self.totals]))) - self.begun
        last = begin[1:][begin[1:] <= len(ids)]
        at, cost = self.places(ids, last, final)
        chosen = np.array(cuts(at.tolist(), cost.tolist(), self.window, max(0, len(ids) - 2 * self.window) if final else None))
        if not final:
            chosen = chosen[chosen <= len(ids) - CARRIED]
        stop = int(chosen[-1])
        edges = np.unique(np.concatenate(([0], last[last < stop], chosen)))
        lo, hi = edges[:-1], edges[1:]
        doc, seq = np.searchsorted(begin, lo, side="right") - 1, np.searchsorted(chosen, lo, side="right")
        starts = np.concatenate(([0], chosen[:-1]))
        pieces = [ids[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        out = {
            "doc_id": [self.keys[d] for d in doc],
            "start": lo - begin[doc],
            "length": hi - lo,
            "ids_crc32": [zlib.crc32(p.tobytes()) for p in pieces],
            "doc_tokens": np.array(self.totals, np.int64)[doc],
            "sequence_id": self.sequence + seq,
            "offset": lo - starts[seq],
            "ids": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids[:stop].view(np.int32))),
        }
        self.sequence += len(chosen)
        done = int(np.searchsorted(begin, stop, side="right")) - 1
        self.parts, self.size = [all_ids[stop:]], len(all_ids) - stop
        self.keys, self.totals, self.begun = self.keys[done:], self.totals[done:], stop - int(begin[done]) if done < len(self.keys) else 0
        return out


def pack(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", with_ids: bool = True, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if wanted."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = {"start": "long", "length": "long", "ids_crc32": "long", "doc_tokens": "long", "sequence_id": "long", "offset": "long"} | ({"ids": "array<int>"} if with_ids else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        stream, key = Stream(encode.ends, encode.spaces, TaskContext.get().partitionId() << 33, window), pa.int64()

        def arrow(out: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out["doc_id"], key), *[out[c] if c == "ids" else pa.array(out[c], pa.int64()) for c in fields]], names=["doc_id", *fields])

        for batch in batches:
            key, keys = batch.column("doc_id").type, batch.column("doc_id").to_pylist()
            for lo, hi, data, at in text_slices(batch, "text"):
                raw = data.tobytes()
                texts = [raw[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                for k, got in zip(keys[lo:hi], encode(texts), strict=True):
                    for out in stream.add(k, np.append(np.frombuffer(got, "<u4"), np.uint32(END_ID))):
                        yield arrow(out)
        if stream.size:
            yield arrow(stream.settle(True))

    return source.mapInArrow(run, ", ".join([f"doc_id {dict(source.dtypes)['doc_id']}", *[f"{k} {v}" for k, v in fields.items()]]))
