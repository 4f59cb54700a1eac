import random
import re
from collections import defaultdict

import numpy as np
import pytest

from sparkloom.llm import minhash
from sparkloom.llm.minhash import drop_near_copies, near_groups
from tests.llm.test_components import brute as reach


def shingles(text, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows, width=4):
    sets = [shingles(t, width) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = reach(links)
    least = defaultdict(list)
    for k in range(len(rows)):
        least[root.get(k, k)].append(rows[k][0])
    return [(rows[k][0], len(sets[k]), min((x for x in least[root.get(k, k)] if x is not None), default=None)) for k in range(len(rows))]


def check(rows, docs_of, width=4):
    got = near_groups(docs_of(rows), width=width).collect()
    order = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=order) == sorted(brute(rows, width), key=order)
    for r in got:
        assert not r.kept or r.doc_id == r.component_id
    # rows with an empty set are alone, each kept, even if they repeat an id
    assert all(r.kept for r in got if not r.n_shingles)
    linked = [r for r in got if r.n_shingles and r.component_id is not None]
    kept = [r.component_id for r in linked if r.kept]
    assert len(kept) == len(set(kept)) == len({r.component_id for r in linked})
    return got


def family(r, text, n, most):
    out = []
    for _ in range(n):
        w = text.split()
        for _ in range(r.randint(0, most)):
            w[r.randrange(len(w))] = "w%d" % r.randint(0, 10**6)
        out.append(" ".join(w))
    return out


def test_odd_rows(docs_of, odd):
    check(odd, docs_of)


@pytest.mark.parametrize("width", [4, 5])
def test_families_and_a_shared_passage(docs_of, prose, width):
    r = random.Random(width)
    passage = prose(1000, 40)
    texts = [prose(i, 30) + " " + passage + " " + prose(i + 500, 30) for i in range(40)]
    for k, most in enumerate((1, 3, 5, 8)):
        texts += family(r, prose(2000 + k, 120), 45, most)
    texts += texts[:8] + [t.upper() for t in texts[50:55]]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    check(rows, docs_of, width)


def test_similarity_at_the_limit(docs_of):
    # ten distinct shingles of which eight are shared: 8 of 12, and 8 of 10 exactly
    base = [f"a{i}" for i in range(13)]
    nine = base[:11]  # 8 of its shingles
    check([(1, " ".join(base)), (2, " ".join(nine)), (3, " ".join(base[:10]))], docs_of)


def test_rows_that_stay(docs_of, prose):
    rows = [(5, prose(1)), (2, prose(1) + " more"), (9, prose(2)), (9, prose(2)), (7, None), (8, "")]
    left = drop_near_copies(docs_of(rows))
    assert left.columns == docs_of(rows).columns
    assert sorted(r.doc_id for r in left.collect()) == [2, 7, 8, 9, 9]


def test_empty_table(docs_of):
    check([], docs_of)


def test_parities_bound_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(50):
        x = rng.integers(0, 2**63, rng.integers(1, 3000)).astype(np.uint64)
        y = np.unique(np.concatenate((x[: rng.integers(0, len(x) + 1)], rng.integers(0, 2**63, 50).astype(np.uint64))))
        apart = sum(int(v).bit_count() for v in (minhash.parities(np.unique(x)) ^ minhash.parities(y)).view(np.uint64))
        assert apart <= len(set(x.tolist()) ^ set(y.tolist()))


def template_pages(seed, n, own):
    """Pages of 100 words of a template, of which each has replaced some runs by words of its own."""
    r = random.Random(seed)
    base = [f"t{k}" for k in range(100)]
    out = []
    for i in range(n):
        w = list(base)
        for k in r.sample(range(0, 100, 10), own):
            w[k + 5] = f"own{i}x{k}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("own", [3, 4, 5, 6])
def test_pages_of_a_template_that_do_not_all_link(docs_of, own):
    texts = template_pages(own, 60, own) + template_pages(7, 20, 1)
    check(list(enumerate(texts)), docs_of)


def test_a_group_of_unlinked_pages_is_not_compared_pair_by_pair(spark):
    least = (minhash.LEAST, minhash.LEAST_OF)
    for own in (5, 6, 8):
        compared = []
        for n in (50, 200):
            made = [minhash.shingle_set(minhash.hashes_of(np.frombuffer(t.encode(), np.uint8))) for t in template_pages(1, n, own)]
            sets = spark.createDataFrame([(i, s.view(np.int64).tolist(), minhash.parities(s).tolist()) for i, s in enumerate(made)], "rep long, shingles array<long>, parities array<long>")
            asked = sets.selectExpr("rep", "rep AS root", "true AS asks")
            left = minhash.prefixes(asked, sets, least).toPandas()
            assert minhash.across(minhash.prefixes(asked, sets, least), least).count() <= n
            sizes = left.groupby(["own", "other", "shingle"]).size().to_dict()
            compared.append(len(left) + sum(k * sizes.get((other, own_band, s), 0) for (own_band, other, s), k in sizes.items()))
        assert compared[1] <= 6 * compared[0] + 1000


def tried(spark, texts):
    """Matches of the keys of the join of ``across`` where every text is its own component, and the pairs that leave it."""
    least = (minhash.LEAST, minhash.LEAST_OF)
    made = [minhash.shingle_set(minhash.hashes_of(np.frombuffer(t.encode(), np.uint8))) for t in texts]
    sets = spark.createDataFrame([(i, s.view(np.int64).tolist(), minhash.parities(s).tolist()) for i, s in enumerate(made)], "rep long, shingles array<long>, parities array<long>")
    left = minhash.prefixes(sets.selectExpr("rep", "rep AS root", "true AS asks"), sets, least)
    keys = left.groupBy("own", "other", "poor", "to_poor", "shingle").count().toPandas()
    sizes = {tuple(k[:5]): k[5] for k in keys.itertuples(index=False)}
    pairs = {tuple(r) for r in minhash.across(left, least).collect()}
    return sum(n * sizes.get((o, w, tp, p, s), 0) for (w, o, p, tp, s), n in sizes.items()), pairs, made


@pytest.mark.parametrize("own", [22, 23, 27])
def test_pages_with_words_of_their_own_at_the_same_places_are_not_tried(spark, own):
    """Similarity 0.788, 0.779 and 0.740: pages of 720 words of a template, ``own`` of them each page's own, at the same places in all pages."""
    found = []
    for n in (100, 200, 400):
        texts = [" ".join(f"own{i}x{k}" if k % 24 == 0 and k // 24 < own else f"t{k}" for k in range(720)) for i in range(n)]
        matches, pairs, made = tried(spark, texts)
        a, b = (set(x.tolist()) for x in made[:2])
        assert 0.739 < len(a & b) / len(a | b) < 0.79 and not pairs
        found.append(matches)
    assert found[1] <= 2.5 * found[0] + 100 and found[2] <= 2.5 * found[1] + 100


def test_poor_and_rich_sets_are_told_apart_without_a_loss(docs_of):
    """Pages with many, few and no words of their own, about the limit."""
    r = random.Random(11)
    base = [f"t{k}" for k in range(150)]
    texts = []
    for i in range(120):
        w = list(base)
        for k in r.sample(range(150), i % 9):
            w[k] = f"own{i}x{k}"
        texts.append(" ".join(w[: 150 - i % 12]))
    check(list(enumerate(texts)), docs_of)


def test_long_texts_in_pieces(monkeypatch):
    text = ("word%d  " * 3000 % tuple(range(3000))).encode()
    whole = minhash.hashes_of(np.frombuffer(text, np.uint8))
    monkeypatch.setattr(minhash, "PIECE", 100)
    assert (minhash.hashes_of(np.frombuffer(text, np.uint8)) == whole).all() and len(whole) == 3000
