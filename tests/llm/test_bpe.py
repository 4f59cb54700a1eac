import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from sparkloom.llm.bpe import Codec, decoded, digests, encoded
from sparkloom.llm.chunks import PieceTable, whole_pieces
from sparkloom.llm.queries_bpe import op1_bpe
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return Codec(PATH, public_tokenizers.PATTERN)


def texts():
    r = random.Random(1)
    out = ["", "  a  b ", "\n \n x", "ab" * 5000, " 　x  y", "don't 'S it's", " 12 345\t\t !!??\r\n  z ", "日本語 テキスト" * 30, "\x00 a", "😀 👨‍👩‍👧", " ", "a \n b", "<|endoftext|> x"]
    return out + ["".join(r.choice(" \n\tab1'!.é sdll\x1c") for _ in range(r.randint(0, 300))) for _ in range(400)]


def test_same_ids_as_the_library(codec, library):
    for t, got in zip(texts(), codec.encode(texts()), strict=True):
        assert got.tolist() == library.encode_ordinary(t)
        assert codec.decode(got) == t.encode()


def test_pieces_put_together_are_the_text():
    for t in texts():
        assert "".join(whole_pieces(t.split(" "))) == t


def test_table_stays_bounded(codec, library):
    codec.table.most = 50
    for _ in range(2):
        assert [x.tolist() for x in codec.encode(texts())] == [library.encode_ordinary(t) for t in texts()]
    codec.table.most = 64 << 20


def test_dataframes(docs_of, odd, library):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r.doc_id: r for r in digests(docs_of(odd), PATH, public_tokenizers.PATTERN).collect()}
    ids = encoded(docs_of(odd), PATH, public_tokenizers.PATTERN)
    back = {r.doc_id: bytes(r.bytes) for r in decoded(ids, PATH, public_tokenizers.PATTERN).collect()}
    for k, t in enumerate(ODD):
        want = library.encode_ordinary(t or "")
        assert got[k].n_tokens == len(want)
        assert got[k].ids_sha256 == sha(",".join(map(str, want)).encode())
        assert got[k].decoded_sha256 == sha((t or "").encode())
        assert back[k] == (t or "").encode()
    assert digests(docs_of([]), PATH, public_tokenizers.PATTERN).count() == 0


def test_what_is_kept():
    """Short pieces, from the second time on; beyond the bound the younger half."""
    made = []
    t = PieceTable(lambda p: made.extend(p) or [x.encode() for x in p], most=10_000)
    long = "日本語" * 1000
    for _ in range(5):
        assert t.joined([long + " a b " + long, "x a"]) == [(long + " a b " + long).encode(), b"x a"]
    assert made.count(" a") == 2 and made.count(long) == 5 and set(t.later) == {"a", "b"} and set(t.first) == {"x"} and not t.first.once
    words = [f"w{k}" for k in range(100)]
    for _ in range(2):
        t.joined([" ".join(words)])
    assert t.later.size > 10_000 and "w99" in t.later
    t.joined(["x"])
    assert t.first.size + t.later.size < 11_000 and "w99" in t.later and "w1" not in t.later


def test_scripts_without_spaces_are_merged_in_matrices(codec, library, monkeypatch):
    r = random.Random(6)
    texts = ["".join(chr(r.randint(lo, hi)) for _ in range(n)) for lo, hi in ((0x4E00, 0x9FFF), (0x0E01, 0x0E2E), (0x0430, 0x044F), (97, 122)) for n in (22, 65, 120, 200, 340)]
    texts += ["今天早上我们去树林里找蘑菇" * k for k in (1, 5, 20, 26)]
    monkeypatch.setattr(codec, "merge_long", None)  # not called
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.pieces(texts)] == [library.encode_ordinary(t) for t in texts]


def test_longer_words_leave_the_matrices(codec, library):
    for text in ("字" * 400, "ab" * 700, "x" * 1025, "ü" * 512, "ü" * 513):
        assert codec.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_query(spark, library):
    data = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert {r[0]: tuple(r[1:4]) for r in op1_bpe(spark, data).collect()} == want
