"""Documents scored by masked pseudo-likelihood.

A small network predicts every word from the two words on either side of it;
the logarithms of these conditional probabilities, summed over a text, are its
score. Words of the network are the ``KNOWN`` most frequent of the whole corpus
and, for all others, one of ``BUCKETS`` hash buckets. The output is factored:
first one of ``CLASSES`` classes of words, then a word of that class. A word in a
bucket adds log P(word | bucket) from its count in the whole corpus, so every
word counts. By Witten and Bell, a bucket of N words, V of them distinct, gives
n / (N + V) to a word seen n times and V / (N + V) to unseen words.

Words are counted on the executors, summed by a shuffle and written as a table
that grows with the corpus. Then documents are dealt by a hash of id and text
into slices, and within a slice into shards of about ``CELL`` words, whatever
files they came from. A round of federated averaging takes one slice: every
shard trains the network on all its texts from the same start, and the
parameters, weighted by their words, are averaged by a shuffle. Rounds go on,
over all slices at least once and then again, until one raises the mean log
likelihood of a word, taken before each step, by less than ``GAIN``. As each
round but the last gains that much, they end. At last every text is scored. Only the
vocabulary, the counts of at most ``FREQUENT`` words, the buckets' totals and the
averaged parameters, all of bounded size, come to the driver; the counts of all
other words are joined by a shuffle.

Defined results: a null or empty text, or one of white space, has 0 tokens, a
log probability of 0 and null means; repeated rows get equal scores; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrow_text import text_slices
from sparkloom.llm.minhash import hashes_of, word_hashes
from sparkloom.session import written

KNOWN, BUCKETS, CLASSES = 4096, 1024, 64
MEMBERS = (KNOWN + BUCKETS) // CLASSES
PAD = KNOWN + BUCKETS
#: Counts of at most so many words are sent to every task; those of rarer words are joined.
FREQUENT = 1 << 19
SIDES = np.array([-2, -1, 1, 2])
WIDTH, HIDDEN = 16, 24
BATCH, RATE = 8192, 1.0
#: Words of a shard in one round; shards that a corpus is dealt into first; slices, and so rounds that an epoch has, at most.
CELL, SHARDS, SLICES = 1 << 18, 8, 16
#: Rounds end when one gains less than so much mean log likelihood a word.
GAIN = 0.05
#: Pieces of the parameters that are averaged apart.
PIECES = 64
#: name: shape of each parameter array
SHAPES = {
    "embed": (PAD + 1, WIDTH),
    "inner": (len(SIDES) * WIDTH, HIDDEN),
    "inner_bias": (HIDDEN,),
    "to_class": (HIDDEN, CLASSES),
    "class_bias": (CLASSES,),
    "to_word": (CLASSES, HIDDEN, MEMBERS),
    "word_bias": (CLASSES, MEMBERS),
}
Parameters = dict[str, np.ndarray]


def start(seed: int = 1) -> Parameters:
    r = np.random.default_rng(seed)
    return {k: (np.zeros(s) if k.endswith("bias") else r.normal(size=s) * (0.3 if k == "embed" else s[-2] ** -0.5)).astype(np.float32) for k, s in SHAPES.items()}


def flat(p: Parameters) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def unflat(x: np.ndarray) -> Parameters:
    ends = np.cumsum([np.prod(s) for s in SHAPES.values()])[:-1]
    return {k: part.reshape(s).astype(np.float32) for (k, s), part in zip(SHAPES.items(), np.split(x, ends), strict=True)}


def word_ids(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Ids of words: places among the sorted known hashes, or a bucket."""
    if not len(known):
        return (KNOWN + hashes % np.uint64(BUCKETS)).astype(np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, KNOWN + (hashes % np.uint64(BUCKETS)).astype(np.int64))


def texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, word hashes, offsets of the rows' words)."""
    for lo, hi, data, at in text_slices(batch, "text"):
        if hi - lo == 1:
            words = hashes_of(data)
            yield lo, hi, words, np.array([0, len(words)])
            continue
        apart = np.full(len(data) + hi - lo, 32, np.uint8)  # a space between texts
        apart[np.arange(len(data)) + np.repeat(np.arange(hi - lo), np.diff(at))] = data
        words, begin = word_hashes(apart)
        yield lo, hi, words, np.searchsorted(begin, at + np.arange(hi - lo + 1))


def contexts(ids: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Tokens x sides: the ids around each token, PAD beyond its text's ends."""
    size = np.diff(cut)
    text = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(ids)) + 2 * text + 2
    apart = np.full(len(ids) + 2 * len(size) + 2, PAD, np.int64)
    apart[at] = ids
    return apart[at[:, None] + SIDES]


def classes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each id, and its place in that class: neighbours in the id order are apart."""
    return ids % CLASSES, ids // CLASSES


def scores(h: np.ndarray, matrix: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Choices x tokens, less each token's largest: in this layout maxima and sums run along memory."""
    z = matrix.T @ h.T + bias[:, None]
    z -= z.max(0)
    return z


def forward(p: Parameters, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = p["embed"][around].reshape(len(around), -1)
    h = np.tanh(x @ p["inner"] + p["inner_bias"])
    return x, h, scores(h, p["to_class"], p["class_bias"])


def chosen(z: np.ndarray, choice: np.ndarray) -> np.ndarray:
    """Log probability of each token's choice."""
    return z[choice, np.arange(len(choice))] - np.log(np.exp(z).sum(0))


def slope(z: np.ndarray, choice: np.ndarray) -> tuple[np.ndarray, float]:
    """Probabilities, less 1 at each token's choice, and the choices' log likelihood; overwrites ``z``."""
    each = np.arange(len(choice))
    likelihood = float(z[choice, each].sum(dtype=np.float64))
    g = np.exp(z, out=z)
    total = g.sum(0)
    g /= total
    g[choice, each] -= 1
    return g, likelihood - float(np.log(total).sum(dtype=np.float64))


def by_class(c: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order of tokens by class, and where each class then stands."""
    ends = np.cumsum(np.bincount(c, minlength=CLASSES)).tolist()
    begins = [0, *ends[:-1]]
    return np.argsort(c.astype(np.int16), kind="stable"), [(k, slice(lo, hi)) for k, (lo, hi) in enumerate(zip(begins, ends, strict=True)) if hi > lo]


def log_probs(p: Parameters, ids: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Log probability of each token given the words around it."""
    c, m = classes(ids)
    order, parts = by_class(c)
    m = m[order]
    _, h, z = forward(p, around[order])
    own = chosen(z, c[order])
    for k, part in parts:
        own[part] += chosen(scores(h[part], p["to_word"][k], p["word_bias"][k]), m[part])
    out = np.empty_like(own)
    out[order] = own
    return out


def step(p: Parameters, ids: np.ndarray, around: np.ndarray, rate: float) -> float:
    """One gradient step on a batch, in place; the batch's log likelihood before it."""
    c, m = classes(ids)
    order, parts = by_class(c)
    m, around = m[order], around[order]
    x, h, z = forward(p, around)
    g, likelihood = slope(z, c[order])
    dh = g.T @ p["to_class"].T
    scale = rate / len(ids)
    for k, part in parts:
        hk = h[part]
        gk, own_likelihood = slope(scores(hk, p["to_word"][k], p["word_bias"][k]), m[part])
        likelihood += own_likelihood
        dh[part] += gk.T @ p["to_word"][k].T
        # a class is trained by its own tokens only, so its step isn't as small as its share of a batch
        own = rate / max(len(hk), len(ids) / CLASSES)
        p["to_word"][k] -= own * (gk @ hk).T
        p["word_bias"][k] -= own * gk.sum(1)
    p["to_class"] -= scale * (g @ h).T
    p["class_bias"] -= scale * g.sum(1)
    dz = dh * (1 - h * h)
    dx = (p["inner"] @ dz.T).reshape(len(SIDES), WIDTH, -1)
    p["inner"] -= scale * (x.T @ dz)
    p["inner_bias"] -= scale * dz.sum(0)
    seen = around.T.ravel()
    # each word's mean gradient, as rare words would hardly move with the batch's
    share = rate / np.maximum(np.bincount(seen, minlength=PAD + 1), 8)
    for k in range(WIDTH):
        p["embed"][:, k] -= share * np.bincount(seen, dx[:, k].ravel(), PAD + 1)
    return likelihood


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: how often each word of all texts occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def sums() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.record_batch({"word": h.view(np.int64), "n": n.astype(np.int64)})

        size = 0
        for batch in batches:
            for _, _, words, _ in texts(batch):
                held.append(words)
                size += len(words)
                if size > 1 << 21:
                    size = 0
                    yield sums()
        if held:
            yield sums()

    return docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, times: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the KNOWN most frequent words, and their counts; ``times`` tells how many words have each count."""
    least, words = 1, 0
    for n, size in sorted(times, reverse=True):
        least, words = n, words + size
        if words >= KNOWN:
            break
    # few more than KNOWN words are sorted, so partitions don't propose KNOWN words each
    top = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(KNOWN).collect()
    words, n = np.array([r["word"] for r in top], np.int64).view(np.uint64), np.array([r["n"] for r in top], np.int64)
    order = np.argsort(words)
    return words[order], n[order]


def times_of(counts: DataFrame) -> list[tuple[int, int]]:
    """(n, number of words that occur n times): about the square root of the corpus in rows."""
    return [(r["n"], r["count"]) for r in counts.groupBy("n").count().collect()]


def vocabulary(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the most frequent words of all texts."""
    counts = written(word_counts(docs), "words")
    return most_frequent(counts, times_of(counts))[0]


def frequent(counts: DataFrame, times: list[tuple[int, int]]) -> tuple[int, np.ndarray, np.ndarray]:
    """(least count, sorted hashes, log counts) of all words that occur at least so often, FREQUENT of them at most."""
    least, words = 1 + max((n for n, _ in times), default=0), 0
    for n, size in sorted(times, reverse=True):
        words += size
        if words > FREQUENT:
            break
        least = n
    rows = counts.filter(F.col("n") >= least).toArrow()
    h, n = rows.column("word").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(h)
    return least, h[order], np.log(n[order])


def bucket_sizes(counts: DataFrame, known: np.ndarray, own: np.ndarray) -> np.ndarray:
    """log(N + V) of each bucket: its words and its distinct words, without the ``known`` ones that occur ``own`` times."""
    each = counts.groupBy(F.col("word").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")).agg((F.sum("n") + F.count("*")).alias("size"))
    size = np.zeros(BUCKETS, np.int64)
    for r in each.collect():
        size[r["bucket"]] = r["size"]
    np.subtract.at(size, (known % np.uint64(BUCKETS)).astype(np.int64), own + 1)
    return np.log(np.maximum(size, 1))


def dealt(docs: DataFrame, words: int) -> tuple[DataFrame, int]:
    """shard, text, slice of all documents as a written table, sorted within each shard, and the number of slices.

    Where a row goes depends on its id and text only, so not on the files; rows without an id are dealt by their place.
    """
    slices = min(SLICES, max(1, words // (SHARDS * CELL)))
    shards = max(min(SHARDS, max(1, words // CELL)), math.ceil(words / (slices * 2 * CELL)))
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("no id "), F.monotonically_increasing_id().cast("string")))
    keyed = docs.select(F.xxhash64(own, "text").alias("key"), "text")
    placed = keyed.select(F.pmod("key", F.lit(shards)).alias("shard"), "key", "text", F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int").alias("slice"))
    sorted_rows = placed.repartition(shards, "shard").sortWithinPartitions("slice", "shard", "key")
    return written(sorted_rows.select("shard", "text", "slice"), "shards", ("slice",)), slices


def taught(docs: DataFrame, known: np.ndarray, p: Parameters, rate: float = RATE) -> tuple[Parameters, float]:
    """One pass over all texts: each shard (or partition, without that column) trains from ``p``, and the results are averaged.

    Also the mean log likelihood of a word, taken before the step that learns from it.
    """
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast((known, p))  # KNOWN hashes and the parameters: fixed sizes

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, begin = sent.value
        total, every, likelihood = np.zeros(len(flat(begin))), 0, 0.0
        own, seen, shard = {k: v.copy() for k, v in begin.items()}, 0, None
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for first, end in zip(cuts, cuts[1:], strict=False):
                if first == end:
                    continue
                if shard is not None and shards[first] != shard:
                    total, every = total + seen * flat(own), every + seen
                    own, seen = {k: v.copy() for k, v in begin.items()}, 0
                shard = shards[first]
                for _, _, words, cut in texts(batch.slice(first, end - first)):
                    ids = word_ids(words, vocabulary)
                    around = contexts(ids, cut)
                    mixed = np.random.default_rng(len(ids)).permutation(len(ids))
                    for lo in range(0, len(ids), BATCH):
                        some = mixed[lo : lo + BATCH]
                        likelihood += step(own, ids[some], around[some], rate)
                    seen += len(ids)
        total, every = total + seen * flat(own), every + seen
        if every:
            parts = np.array_split(total, PIECES)
            yield pa.record_batch({"piece": pa.array(range(PIECES), pa.int32()), "weight": [float(every)] * PIECES, "likelihood": [likelihood] * PIECES, "total": pa.array([x.tobytes() for x in parts], pa.binary())})

    def sums(found: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_py()) for x in found.column("total")], 0)
        weight, likelihood = (sum(found.column(c).to_pylist()) for c in ("weight", "likelihood"))
        return pa.table({"piece": found.column("piece")[:1], "likelihood": [likelihood / weight], "mean": pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())})

    rows = docs if "shard" in docs.columns else docs.withColumn("shard", F.lit(0).cast("long"))
    each = rows.select("shard", "text").mapInArrow(learn, "piece int, weight double, likelihood double, total binary")
    mean = each.groupBy("piece").applyInArrow(sums, "piece int, likelihood double, mean binary").collect()
    sent.unpersist()
    if not mean:
        return p, 0.0
    return unflat(np.concatenate([np.frombuffer(r["mean"], np.float32) for r in sorted(mean, key=lambda r: r["piece"])])), mean[0]["likelihood"]


def trained(docs: DataFrame, known: np.ndarray, p: Parameters, rate: float = RATE) -> Parameters:
    """The averaged parameters of one pass over all texts."""
    return taught(docs, known, p, rate)[0]


def converged(docs: DataFrame, known: np.ndarray, words: int, gain: float = GAIN) -> tuple[Parameters, list[float]]:
    """Parameters after rounds over all texts until one gains less than ``gain``, and the mean log likelihood of each round."""
    p, found = start(), []
    if not words:
        return p, found
    rows, slices = dealt(docs, words)
    while len(found) < max(2, slices) or found[-1] - found[-2] >= gain:
        p, likelihood = taught(rows.filter(F.col("slice") == len(found) % slices), known, p)
        found.append(likelihood)
    return p, found


def scored(docs: DataFrame, known: np.ndarray, p: Parameters) -> DataFrame:
    """doc_id, n_tokens, log_prob, mean_log_prob, perplexity of each text by the network alone: words in a bucket are alike."""
    each = network_scores(docs, known, p, None)
    return finished(each)


def finished(each: DataFrame) -> DataFrame:
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return each.select("doc_id", "n_tokens", "log_prob", mean.alias("mean_log_prob"), F.exp(-mean).alias("perplexity"))


def network_scores(docs: DataFrame, known: np.ndarray, p: Parameters, shares: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> DataFrame:
    """row, doc_id, n_tokens, log_prob, and the words in ``rarer`` whose log counts are still to be added.

    ``shares``: sorted hashes of frequent words, their log counts, and log(N + V) of each bucket.
    """
    sent = docs.sparkSession.sparkContext.broadcast((known, p, shares))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, model, shares = sent.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo, hi, words, cut in texts(batch):
                ids = word_ids(words, vocabulary)
                around = contexts(ids, cut)
                each = np.concatenate([np.zeros(0), *(log_probs(model, ids[k : k + BATCH], around[k : k + BATCH]) for k in range(0, len(ids), BATCH))])
                rarer, ends = np.zeros(0, np.int64), np.zeros(hi - lo + 1, np.int64)
                if shares is not None:
                    hashes, logs, sizes = shares
                    at = np.flatnonzero(ids >= KNOWN)
                    own = words[at]
                    each[at] -= sizes[(own % np.uint64(BUCKETS)).astype(np.int64)]
                    place = np.minimum(np.searchsorted(hashes, own), max(0, len(hashes) - 1))
                    there = hashes[place] == own if len(hashes) else np.zeros(len(own), bool)
                    each[at[there]] += logs[place[there]]
                    rarer = own[~there].view(np.int64)
                    ends = np.searchsorted(at[~there], cut)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + hi - lo)),
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array(np.diff(cut).astype(np.int64)),
                        pa.array(np.diff(np.concatenate(([0.0], np.cumsum(each)))[cut])),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rarer)),
                    ],
                    names=["row", "doc_id", "n_tokens", "log_prob", "rarer"],
                )
                row += hi - lo

    return docs.mapInArrow(run, f"row long, doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, log_prob double, rarer array<long>")


def pseudo_likelihood(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", gain: float = GAIN) -> DataFrame:
    """Train on all texts and score all texts."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counts = written(word_counts(source), "words")
    times = times_of(counts)
    known, own = most_frequent(counts, times)
    p, _ = converged(source, known, sum(n * size for n, size in times), gain)
    least, hashes, logs = frequent(counts, times)
    each = written(network_scores(source, known, p, (hashes, logs, bucket_sizes(counts, known, own))), "scores")
    # the logarithm of a count of 1 adds nothing
    rarer = counts.filter((F.col("n") > 1) & (F.col("n") < least))
    words = each.select("row", F.explode("rarer").alias("word"))
    sums = words.join(rarer, "word").groupBy("row").agg(F.sum(F.log("n")).alias("more"))
    return finished(each.join(sums, "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("more", F.lit(0.0))))
