import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import packing
from sparkloom.llm.packing import cuts, pack
from sparkloom.llm.queries_packing import op6_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def dearest(places, costs, window, even_from):
    """All ways tried by plain dynamic programming."""
    best = {0: 0.0}
    for p, c in zip(places, costs):
        own = []
        for q, b in best.items():
            if p - q <= window:
                even = even_from is not None and p >= even_from and (p - q) & (p - q - 1) == 0
                own.append(b + c + (0 if even else window - (p - q)))
        best[p] = min(own)
    return best[places[-1]]


@pytest.mark.parametrize("even", [True, False])
def test_cheapest_cuts(even):
    r = random.Random(3)
    for _ in range(200):
        window = r.choice([8, 16, 32])
        places = sorted(set(np.cumsum([r.randint(1, window // 2) for _ in range(r.randint(1, 40))]).tolist()))
        costs = [float(r.choice([0, 0, 2, 12])) for _ in places]
        even_from = places[-1] // 2 if even else None
        got = cuts(places, costs, window, even_from)
        total, before = 0.0, 0
        for p in got:
            assert p - before <= window
            n = p - before
            total += costs[places.index(p)] + (0 if even and p >= even_from and n & (n - 1) == 0 else window - n)
            before = p
        assert got[-1] == places[-1] and total == dearest(places, costs, window, even_from)


def check(df, rows, window=2048):
    t = Tokenizer.from_file(PATH)
    want = {k: [*e.ids, 1] for (k, _), e in zip(rows, t.encode_batch([x or "" for _, x in rows], add_special_tokens=False), strict=True)}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in pack(df, PATH, window=window).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) > 0
    for k, ids in want.items():
        own = sorted(pieces.pop(k), key=lambda r: r.start)
        assert sum((list(r.ids) for r in own), []) == ids
        assert [r.start for r in own] == np.concatenate(([0], np.cumsum([r.length for r in own])[:-1])).tolist()
        assert {r.doc_tokens for r in own} == {len(ids)}
    padding = total = 0
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        n = sum(r.length for r in own)
        assert n <= window and [r.offset for r in own] == np.concatenate(([0], np.cumsum([r.length for r in own])[:-1])).tolist()
        padding, total = padding + (0 if n & (n - 1) == 0 else window - n), total + n
    return pieces, padding / max(1, padding + total)


def test_odd_rows(docs_of, odd):
    unique = [r for r in dict(odd[:-2]).items()]
    rest, _ = check(docs_of(odd[:-3] + [(None, "no id"), (None, "no id")]), unique)
    assert sum(r.doc_tokens for r in rest[None] if r.start == 0) == 2 * rest[None][0].doc_tokens
    assert pack(docs_of([]), PATH).count() == 0


def test_special_strings_in_texts_become_their_token(docs_of):
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "x<|endoftext|><|endoftext|> y  "), (4, "<|endoftext| > <|endoftext")]
    check(docs_of(rows), rows)


def test_blocks_are_joined_and_padding_is_small(docs_of, prose, monkeypatch):
    rows = [(i, ". ".join(prose(i * 100 + k, 12) for k in range(i % 30 + 1)) + ".\nend") for i in range(200)]
    _, padding = check(docs_of(rows, 1), rows)
    assert padding < 0.02


def test_small_blocks(docs_of, prose):
    stream_rows = [(i, prose(i, 300)) for i in range(30)]
    before = packing.BLOCK, packing.CARRIED
    packing.BLOCK, packing.CARRIED = 1 << 12, 256
    try:
        encode, out = packing.encoder(PATH), []
        s = packing.Stream(encode.ends, encode.spaces, 0, 64)
        for k, t in stream_rows:
            for o in s.add(k, np.append(np.frombuffer(encode([t])[0], "<u4"), np.uint32(1))):
                out.append(o)
        out.append(s.settle(True))
    finally:
        packing.BLOCK, packing.CARRIED = before
    assert len(out) > 3
    got = defaultdict(list)
    for o in out:
        for k, start, n in zip(o["doc_id"], o["start"], o["length"]):
            got[k].append((int(start), int(n)))
    for k, t in stream_rows:
        at = 0
        for start, n in sorted(got[k]):
            assert start == at
            at += n
        assert at == len(encode([t])[0]) // 4 + 1
    ids = [s for o in out for s in o["sequence_id"].tolist()]
    assert sorted(set(ids)) == list(range(max(ids) + 1))


def test_query(spark):
    """The registered query's pieces: ids, places and sequences as the contract names them."""
    data, t = "/root/testdata/sf0.001", Tokenizer.from_file(PATH)
    docs = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 1] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = op6_packing(spark, data)
    assert got.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    taken, sequences = defaultdict(list), defaultdict(list)
    for r in got.collect():
        ids = docs[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(docs[r.doc_id])
        taken[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for k, ids in docs.items():
        assert sum(n for _, n in taken[k]) == len(ids) and len(set(taken[k])) == len(taken[k])
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
