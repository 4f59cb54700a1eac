import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import fingerprints, queries_fingerprints
from sparkloom.llm.fingerprints import Digest, counts, difference, fingerprint, likeness, likeness_of, with_next

DATA = "/root/testdata/sf0.001"


def slow_counts(data):
    """Each triplet by itself, in whole numbers."""
    found = [0] * fingerprints.BUCKETS
    marked = [256, 256, *data, 257, 257] if data else []
    k0, k1, k2, k3 = map(int, fingerprints.MIX)
    for a, b, c in zip(marked, marked[1:], marked[2:]):
        mixed = (a * k0 + b * k1 + c * k2) % 2**32 ^ (a * k1 + b * k2 + c * k0) % 2**32 >> 15
        found[mixed * k3 % 2**32 >> 24] += 1
    return found


def slow_codes(n):
    s = sorted(n)
    return [sum(x > s[q * len(n) // 4 - 1] for q in (1, 2, 3)) for x in n]


def brute(rows):
    """One sorted list of (doc_id, text)."""
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for i, (k, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        part = len(t) // 4
        edited = t[: len(t) - part] + after[:part]
        own, other, following = (str(Digest.of(x)) for x in (t, edited, after))
        out.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), own, other, likeness(own, other), likeness(own, following)))
    return sorted(out, key=repr)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300))
def test_counts_and_codes_equal_plain_loops(data):
    assert counts(data).tolist() == slow_counts(data)
    d = Digest.of(data.decode("latin-1"))
    assert d.codes.tolist() == slow_codes(slow_counts(data.decode("latin-1").encode()))
    again = Digest.read(str(d))
    assert again.codes.tolist() == d.codes.tolist() and again.level == d.level and str(again) == str(d)


def test_slices_count_every_triplet(monkeypatch):
    data = random.Random(5).randbytes(1000)
    whole = counts(data)
    for size in (1, 7, 500, 1002, 1004):
        monkeypatch.setattr(fingerprints, "SLICE", size)
        assert np.array_equal(counts(data), whole)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60), st.text(max_size=60))
def test_difference_is_bounded_and_symmetric(a, b):
    x, y = Digest.of(a), Digest.of(b)
    assert 0 <= difference(x, y) == difference(y, x) <= 1 and difference(x, x) == 0
    assert (str(x) == str(y)) == (difference(x, y) == 0)


def test_likeness_tells_edits_from_other_texts(prose):
    texts = [prose(i, 40 + 20 * i) for i in range(30)]
    for i, t in enumerate(texts):
        words = t.split(" ")
        for k in range(0, len(words), 10):
            words[k] = "changed"
        edited, other = likeness(str(Digest.of(t)), str(Digest.of(" ".join(words)))), likeness(str(Digest.of(t)), str(Digest.of(texts[i - 1])))
        assert edited > 0.6 and edited > other


@pytest.mark.parametrize("ranges", [None, 1, 2, 50])
def test_every_document_meets_the_next(docs_of, odd, prose, ranges):
    rows = odd + [(i, prose(i, i % 40)) for i in random.Random(1).sample(range(-500, 5000), 120)]
    got = [tuple(r) for r in with_next(docs_of(rows, 5), ranges).collect()]
    assert sorted(got, key=repr) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(7, "alone in the table")], [(None, None)], [(1, "a"), (1, "a")], [(1, "same id"), (1, "other text"), (1, "same id")], [(2**62 + i, f"text {i} " * 5) for i in range(9)]])
def test_small_tables(docs_of, rows):
    assert sorted((tuple(r) for r in with_next(docs_of(rows, 2), 8).collect()), key=repr) == brute(rows)


def test_columns(spark, docs_of):
    df = docs_of([(1, "one text"), (2, None), (3, "one text")]).select("doc_id", fingerprint("text").alias("f"))
    f = {r.doc_id: r.f for r in df.collect()}
    assert f[1] == f[3] != f[2] and all(len(x) == 4 + fingerprints.BUCKETS // 2 for x in f.values())
    one = df.select(likeness_of("f", F.lit(f[1])).alias("x"), likeness_of("f", F.lit(None).cast("string")).alias("none"))
    assert sorted(r.x for r in one.collect())[1:] == [1.0, 1.0] and {r.none for r in one.collect()} == {None}


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = queries_fingerprints.op13_fingerprints(spark, DATA).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
    # a text whose last quarter is another's stays nearer than the other text, but for copies
    assert np.mean([r.near_edited > r.near_next for r in got]) > 0.97
