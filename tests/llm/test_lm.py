import numpy as np
import pytest

from sparkloom.llm import lm
from sparkloom.llm.lm import contexts, log_probs, pseudo_likelihood, scored, start, step, trained, vocabulary, word_ids
from sparkloom.llm.minhash import hashes_of


def plain(p, ids, k):
    """Log probability of one token by plain arithmetic."""
    around = [ids[k + s] if 0 <= k + s < len(ids) else lm.PAD for s in lm.SIDES]
    x = np.concatenate([p["embed"][a] for a in around]).astype(float)
    h = np.tanh(x @ p["inner"] + p["inner_bias"])
    c, m = ids[k] % lm.CLASSES, ids[k] // lm.CLASSES
    a, b = h @ p["to_class"] + p["class_bias"], h @ p["to_word"][c] + p["word_bias"][c]
    return a[c] - np.log(np.exp(a).sum()) + b[m] - np.log(np.exp(b).sum())


def test_log_probs_against_loops():
    p, r = start(3), np.random.default_rng(0)
    texts = [r.integers(0, lm.PAD, n) for n in (0, 1, 2, 7, 0, 30)]
    ids, cut = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    got = log_probs(p, ids, contexts(ids, cut))
    assert np.allclose(got, [plain(p, t.tolist(), k) for t in texts for k in range(len(t))], atol=1e-4)


def test_probabilities_of_all_words_sum_to_one():
    p = start(4)
    every = np.arange(lm.PAD)
    assert abs(np.exp(log_probs(p, every, np.tile([1, 2, 3, 4], (lm.PAD, 1)))).sum() - 1) < 1e-3


def test_steps_raise_the_likelihood():
    p, r = start(), np.random.default_rng(1)
    ids = np.tile(r.integers(0, 50, 40), 50)
    around = contexts(ids, np.array([0, len(ids)]))
    before = log_probs(p, ids, around).mean()
    for _ in range(60):
        step(p, ids, around, 1.0)
    assert log_probs(p, ids, around).mean() > before + 3


def test_words_of_all_documents_count(docs_of, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 3)
    rows = [(i, "a b") for i in range(5)] + [(9, "B c c c c c c c"), (8, None)]
    want = sorted(hashes_of(np.frombuffer(w, np.uint8))[0] for w in (b"a", b"b", b"c"))
    assert vocabulary(docs_of(rows).select("doc_id", "text")).tolist() == want
    ids = word_ids(hashes_of(np.frombuffer(b"a b c d", np.uint8)), np.array(want, np.uint64))
    assert sorted(ids[:3].tolist()) == [0, 1, 2] and ids[3] >= 3


def test_partitions_are_averaged(docs_of, prose):
    docs = docs_of([(i, prose(i % 3, 50)) for i in range(12)], 3).select("doc_id", "text")
    known = vocabulary(docs)
    first = start()
    got = trained(docs, known, first)
    assert all(got[k].shape == first[k].shape and np.isfinite(got[k]).all() for k in first)
    assert not np.allclose(got["class_bias"], first["class_bias"])
    mean = lambda p: scored(docs, known, p).agg({"log_prob": "sum"}).first()[0]
    assert mean(got) > mean(first)


@pytest.mark.parametrize("sent", [0, 2, 1 << 19])
def test_rare_words_count_by_their_own_frequency(docs_of, prose, monkeypatch, sent):
    monkeypatch.setattr(lm, "FREQUENT", sent)
    # four words of one bucket that occur 9, 4, 2 and 1 times, beyond 4,096 words that occur 10 times
    found: dict[int, list[str]] = {}
    for k in range(100_000):
        own = found.setdefault(int(hashes_of(np.frombuffer(f"w{k}".encode(), np.uint8))[0] % np.uint64(lm.BUCKETS)), [])
        own.append(f"w{k}")
        if len(own) == 4:
            break
    rows = [(k, " ".join(f"known{i}" for i in range(lm.KNOWN))) for k in range(10)]
    rows += [(100 + i, " ".join([w] * n)) for i, (w, n) in enumerate(zip(own, (8, 3, 1, 0), strict=True))]
    rows += [(200 + i, f"known1 {w} known2") for i, w in enumerate(own)]
    got = {r.doc_id: r for r in pseudo_likelihood(docs_of(rows)).collect()}
    logs = [got[200 + i].log_prob for i in range(4)]
    assert np.allclose(np.diff(logs), np.diff(np.log([9, 4, 2, 1])), atol=1e-3)
    assert len(got) == len(rows) and all(abs(r.perplexity - np.exp(-r.log_prob / r.n_tokens)) < 1e-6 * r.perplexity for r in got.values() if r.n_tokens)


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    few, many = ({r.doc_id: r.mean_log_prob for r in pseudo_likelihood(docs.repartition(n)).collect()} for n in (3, 300))
    assert few.keys() == many.keys() and all(abs(few[k] - many[k]) < 0.02 for k in few)


def test_rounds_follow_from_convergence(spark, monkeypatch):
    monkeypatch.setattr(lm, "CELL", 2000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    known, words = vocabulary(docs), 50_000
    rows, slices = lm.dealt(docs, words)
    assert slices == 3 and sorted(r.text for r in rows.collect()) == sorted(r.text for r in docs.collect())
    p, found = lm.converged(docs, known, words, 0.05)
    assert len(found) > slices and found[-1] - found[-2] < 0.05 and found[-1] > found[0] + 0.2
    assert all(np.isfinite(x).all() for x in p.values())


def test_odd_rows(docs_of, odd):
    got = pseudo_likelihood(docs_of(odd)).collect()
    assert len(got) == len(odd)
    for r in got:
        text = dict(odd[:-2]).get(r.doc_id, "no id")
        n = len((text or "").translate(dict.fromkeys(range(28, 32), "x")).split())
        assert r.n_tokens == n and (r.log_prob < 0) == (n > 0) and (r.mean_log_prob is None) == (n == 0)
    assert pseudo_likelihood(docs_of([])).count() == 0


def test_usual_text_scores_above_shuffled_letters(spark, prose):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd_one = spark.createDataFrame([(-1, prose(7, 200))], "doc_id long, text string")
    got = {r.doc_id: r.mean_log_prob for r in pseudo_likelihood(docs.unionByName(odd_one)).collect()}
    assert got[-1] < np.median([v for k, v in got.items() if k >= 0])
