"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For every bit a binary classifier over
hashed byte n-grams tells the languages with a 1 from those with a 0: log odds
of the n-grams, averaged over a text and put on a common scale by a logistic
fit. Decoding weighs each bit's logistic loss by that bit's accuracy, takes the
codeword with the least loss, and flags a text as ambiguous when the nearest
two lie close.

Training reads a bounded sample: about ``SAMPLE`` distinct labelled texts of each
language, or all if there are fewer, chosen by a hash. Their n-grams are summed by
language on the executors; the driver gets those sums and, after a second pass, the
log odds of each text, neither of which grows with the length of texts.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
with no labelled rows at all everything is ``und``; with one language that one
is predicted. Repeated rows get equal results. Other columns pass through, and
columns named like the results are replaced.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrow_text import text_slices
from sparkloom.session import written

UNDETERMINED = "und"
#: About so many distinct labelled texts of each language are learned from.
SAMPLE = 1000
#: Byte pairs have an entry each; byte triples are hashed to as many.
SIZE = 1 << 16
#: A text whose best language has less probability than this is ambiguous.
CLEAR = 0.6
#: A share of 1 in sums of shares.
ONE = 1 << 40
CHUNK = 1 << 18


def _fold() -> np.ndarray:
    """Lower case for A-Z; every ASCII byte that is no letter becomes a space."""
    table = np.arange(256, dtype=np.uint32)
    table[:128] = 32
    for a in range(97, 123):
        table[a] = table[a - 32] = a
    return table


FOLD = _fold()


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of the byte pairs and triples that begin at each byte (n-1 and n-2 of them)."""
    b = FOLD[data]
    pairs = (b[:-1] << np.uint32(8)) | b[1:]
    triples = ((pairs[:-1] << np.uint32(8)) | b[2:]) * np.uint32(2654435761) >> np.uint32(16)
    return pairs, triples + np.uint32(SIZE)


def counts(data: np.ndarray) -> np.ndarray:
    """Share of each entry among the n-grams of one text, read piece by piece."""
    total = np.zeros(2 * SIZE, np.float64)
    for lo in range(0, len(data), CHUNK):
        for g in grams(data[lo : lo + CHUNK + 2]):
            total += np.bincount(g[:CHUNK], minlength=2 * SIZE)
    return total / max(1.0, total.sum())


@dataclass
class Model:
    """languages; code: a row of -1 and 1 for each; weights: entries x bits; scale and shift of a bit's log odds; trust in each bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    trust: np.ndarray

    def losses(self, odds: np.ndarray) -> np.ndarray:
        """Texts x languages, from texts x bits of averaged log odds."""
        f = odds * self.scale + self.shift
        loss = np.logaddexp(0.0, -f[:, None, :] * self.code[None])
        return (loss * self.trust).sum(2)

    def probabilities(self, odds: np.ndarray) -> np.ndarray:
        """Texts x languages, from texts x bits of averaged log odds."""
        total = self.losses(odds)
        p = np.exp(total.min(1, keepdims=True) - total)
        return p / p.sum(1, keepdims=True)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """Exhaustive codes up to five languages, else the best of many random ones by least distance."""
    if n <= 5:
        bits = [[1] + [1 if (b >> i) & 1 else -1 for i in range(n - 1)] for b in range(2 ** (n - 1) - 1)]
        return np.array(bits, np.float64).T.reshape(n, -1)
    rng, length, best, found = np.random.default_rng(seed), 4 * math.ceil(math.log2(n)) + 8, -1, None
    for _ in range(300):
        code = rng.choice([-1.0, 1.0], size=(n, length))
        apart = (length - np.where(np.eye(n, dtype=bool), -length, code @ code.T)) / 2
        uneven = (np.abs(code.sum(0)) == n).any()
        if not uneven and apart.min() > best:
            best, found = apart.min(), code
    return found


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sampled(docs: DataFrame, text: str, label: str, sample: int) -> DataFrame:
    """lang, half (0 or 1), text: distinct texts that are learned from, as a written table."""
    usable = docs.select(F.col(label).alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null and length(text) > 0")
    # distinct texts, as copies are chosen together and learned from once
    sizes = {r["lang"]: max(1, r["n"]) for r in usable.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n))]) if sizes else F.create_map(F.lit(""), F.lit(0.0))
    chosen = usable.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20)).dropDuplicates()
    return written(chosen.select("lang", F.pmod(F.xxhash64("text", F.lit(1)), F.lit(2)).cast("int").alias("half"), "text"), "taught")


def gram_sums(chosen: DataFrame) -> DataFrame:
    """lang, half, entry, share: shares of the n-grams, summed over texts in whole numbers, so that their order doesn't matter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, half), total in sums.items():
                k = np.flatnonzero(total)
                yield pa.record_batch({"lang": pa.repeat(lang, len(k)), "half": pa.array(np.full(len(k), half, np.int32)), "entry": pa.array(k.astype(np.int32)), "share": pa.array(total[k])})
            sums.clear()

        for batch in batches:
            langs, halves = batch.column("lang").to_pylist(), batch.column("half").to_pylist()
            for lo, hi, data, at in text_slices(batch, "text"):
                for i in range(lo, hi):
                    own = np.rint(counts(data[at[i - lo] : at[i - lo + 1]]) * ONE).astype(np.int64)
                    key = (langs[i], halves[i])
                    sums[key] = sums[key] + own if key in sums else own
                    if len(sums) > 64:  # of 1 MB each
                        yield from out()
        yield from out()

    return chosen.mapInArrow(count, "lang string, half int, entry int, share long").groupBy("lang", "half", "entry").agg(F.sum("share").alias("share"))


def odds_of(chosen: DataFrame, weights: np.ndarray) -> DataFrame:
    """lang, half, odds: each text's averaged log odds by every column of the weights."""
    sent = chosen.sparkSession.sparkContext.broadcast(weights)  # 2 * SIZE rows, a column a bit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in text_slices(batch, "text"):
                odds = log_odds(sent.value, data, at)
                part = batch.slice(lo, hi - lo)
                yield pa.record_batch({"lang": part.column("lang"), "half": part.column("half"), "odds": pa.array(list(odds), pa.list_(pa.float64()))})

    return chosen.mapInArrow(run, "lang string, half int, odds array<double>")


def bit_weights(mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codewords of languages and the weights of every entry for each bit, from languages x entries of mean shares."""
    code = codewords(len(mean)) if len(mean) else np.zeros((0, 0))
    mean = mean + 1e-6
    columns = [np.clip(np.log(mean[c > 0].mean(0) / mean[c < 0].mean(0)), -4, 4) for c in code.T]
    return code, np.array(columns, np.float32).T.reshape(mean.shape[1], -1)


def calibrated(languages: list[str], code: np.ndarray, weights: np.ndarray, truth: np.ndarray, odds: np.ndarray) -> Model:
    """The model whose bits are put on a common scale and trusted by labelled texts: ``truth`` is a place among the languages, odds are texts x bits."""
    bits, n = code.shape[1], len(truth)
    scale, shift, trust = np.ones(bits), np.zeros(bits), np.ones(bits)
    for b in range(bits):
        y, x = code[truth, b], odds[:, b]
        scale[b], shift[b] = logistic(x, y)
        right = ((x * scale[b] + shift[b] > 0) == (y > 0)).mean()
        trust[b] = math.log(max(right, 0.5) * n + 1) - math.log((1 - right) * n + 1)
    trust = np.maximum(trust, 1e-3) / max(1e-3, trust.mean()) if bits else trust
    return Model(languages, code, weights, scale, shift, trust)


def learned(docs: DataFrame, text: str = "text", label: str = "lang", sample: int = SAMPLE) -> tuple[Model | None, float]:
    """The model of the labelled texts, and the loss above which a decoding is unreliable.

    Each half of the texts is decoded by what the other half teaches as well. Those
    decoded right are clean, clearly or not, as a text may mix languages; the limit is
    the largest loss among them. Without any, or with fewer than two languages, there
    is no limit.

    What comes to the driver: sums of n-gram shares, 2 * SIZE entries for each half of
    a language at most, then some log odds of each text of the bounded sample. Neither
    grows with the length of texts.
    """
    chosen = sampled(docs, text, label, sample)
    numbers = {(r["lang"], r["half"]): r["n"] for r in chosen.groupBy("lang", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted({lang for lang, _ in numbers})
    if not languages:
        return None, math.inf
    sums = {key: np.zeros(2 * SIZE) for key in numbers}
    found = gram_sums(chosen).toArrow()
    for key in numbers:
        own = found.filter((pc.field("lang") == key[0]) & (pc.field("half") == key[1]))
        sums[key][own.column("entry").to_numpy()] = own.column("share").to_numpy() / ONE
    sets = []  # (languages, code, weights) of all texts, and of either half
    for halves in ((0, 1), (0,), (1,)):
        names = [x for x in languages if any((x, h) in numbers for h in halves)]
        mean = [sum(sums[x, h] for h in halves if (x, h) in numbers) / sum(numbers.get((x, h), 0) for h in halves) for x in names]
        sets.append((names, *bit_weights(np.array(mean).reshape(len(names), 2 * SIZE))))
    rows = sorted((r["lang"], r["half"], *r["odds"]) for r in odds_of(chosen, np.hstack([w for _, _, w in sets])).collect())
    lang, half, odds = np.array([r[0] for r in rows], object), np.array([r[1] for r in rows]), np.array([r[2:] for r in rows], np.float64).reshape(len(rows), -1)
    models, at, largest = [], 0, -math.inf
    for k, (names, code, weights) in enumerate(sets):
        own = odds[:, at : at + code.shape[1]]
        at += code.shape[1]
        place = np.array([names.index(x) if x in names else -1 for x in lang])
        taught = half == k - 1 if k else np.ones(len(rows), bool)
        models.append(calibrated(names, code, weights, place[taught], own[taught]) if names else None)
        if k and len(names) > 1 and not taught.all():
            loss = models[k].losses(own[~taught])
            largest = max(largest, loss.min(1)[loss.argmin(1) == place[~taught]].max(initial=-math.inf))
    return models[0], largest if largest > 0 and len(languages) > 1 else math.inf


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and shift of a balanced one-dimensional logistic fit, by Newton steps; y is -1 or 1."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    a, c = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + c, -30, 30)))
        r, h = weight * (p - (y > 0)), weight * p * (1 - p) + 1e-12
        g = np.array([r @ x + ridge * a, r.sum()])
        m = np.array([[h @ (x * x) + ridge, h @ x], [h @ x, h.sum() + ridge * 1e-3]])
        d = np.linalg.solve(m, g)
        a, c = a - d[0], c - d[1]
    return a, c


def train(docs: DataFrame, text: str = "text", label: str = "lang", sample: int = SAMPLE) -> Model | None:
    return learned(docs, text, label, sample)[0]


#: Evidence (a difference of log likelihoods) that decides.
EVIDENCE = 7.0
VOWELS = frozenset("aeiouyæøœıəɛɔ")


def favours(k: int, n: int, one: float, other: float) -> bool:
    """Whether k of n speak clearly for the rate ``one`` against ``other``."""
    return k * math.log(one / other) + (n - k) * math.log((1 - one) / (1 - other)) > EVIDENCE


def noisy(text: str) -> bool:
    """Whether a text shows by itself that it isn't written in any language.

    Any of: a quarter of its characters other than white space are letters or marks
    rather than three quarters; its triples of characters are fewer than the root of
    their number; its Latin letters are vowels at a rate of a tenth rather than of a
    third; they are spread as evenly over the alphabet as chance would do it. Each
    needs evidence that grows with the text, so little text is never noise.
    """
    solid = "".join(text.split())
    letters = Counter(c for c in solid.lower() if unicodedata.category(c)[0] in "LM")
    if favours(letters.total(), len(solid), 0.25, 0.75):
        return True
    triples = len({text[i : i + 3] for i in range(len(text) - 2)})
    if len(text) > 2 * EVIDENCE and triples < min(512, math.sqrt(len(text))):
        return True
    latin: Counter = Counter()
    for c, n in letters.items():
        base = unicodedata.normalize("NFD", c)[0]
        if "a" <= base <= "z" or base in VOWELS:
            latin[base] += n
    n = latin.total()
    if 2 * n < letters.total():
        return False
    if favours(sum(k for c, k in latin.items() if c in VOWELS), n, 0.1, 1 / 3):
        return True
    # twice the log likelihood by which the letters' own shares beat even ones: 25 by chance, about half a letter in languages
    uneven = 2 * sum(k * math.log(26 * k / n) for k in latin.values()) if n else 0.0
    return uneven < 40 and n > 200


def log_odds(weights: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Texts x bits: averaged weights of each text's n-grams. Works through the bytes in pieces of fixed size."""
    n, total = len(at) - 1, np.zeros((len(at) - 1, weights.shape[1]), np.float64)
    for lo in range(0, len(data), CHUNK):
        piece = data[lo : lo + CHUNK + 2]
        for k, g in enumerate(grams(piece), 1):
            g = g[:CHUNK]
            first, end = np.clip(at[:-1] - lo, 0, len(g)), np.clip(at[1:] - k - lo, 0, len(g))
            rows = np.flatnonzero(end > first)
            if len(rows):
                cut = np.empty(2 * len(rows), np.int64)
                cut[::2], cut[1::2] = first[rows], end[rows]
                found = weights[g]
                if cut[-1] == len(g):
                    cut = cut[:-1]
                total[rows] += np.add.reduceat(found, cut, axis=0)[::2]
    size = np.maximum(0, np.diff(at) - 1) + np.maximum(0, np.diff(at) - 2)
    return total / np.maximum(1, size)[:, None]


def with_language(docs: DataFrame, model: Model | None, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous"), limit: float = math.inf) -> DataFrame:
    """``docs`` with the predicted language, its probability and the flag of ambiguity. Noisy texts whose decoding has a loss above ``limit`` are ``und``."""
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    if model is None or len(model.languages) < 2:
        only = model.languages[0] if model else UNDETERMINED
        sure = letter & F.lit(model is not None)
        return docs.withColumns({names[0]: F.when(sure, only).otherwise(UNDETERMINED), names[1]: F.when(sure, 1.0).otherwise(0.0), names[2]: ~sure})
    kept = [c for c in docs.columns if c not in names]
    marked = docs.select(*[F.col(f"`{c}`") for c in kept], letter.alias("__has_letter"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 * SIZE entries a bit: a size that doesn't grow with the input
    schema = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit("").alias(names[0]), F.lit(0.0).alias(names[1]), F.lit(True).alias(names[2])).schema
    ends = sorted({names[0]: "", names[1]: 0.0, names[2]: True}, key=names.index)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        labels = np.array([*m.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            has = batch.column("__has_letter").to_numpy(zero_copy_only=False)
            for lo, hi, data, at in text_slices(batch, text):
                odds = log_odds(m.weights, data, at)
                p = m.probabilities(odds)
                told = has[lo:hi].copy()
                for i in np.flatnonzero(told & (m.losses(odds).min(1) > limit)):
                    told[i] = not noisy(batch.column(text)[lo + int(i)].as_py())
                best, score = np.where(told, p.argmax(1), -1), np.where(told, p.max(1), 0.0)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], pa.array(labels[best], pa.string()), pa.array(score, pa.float64()), pa.array(score < CLEAR)], names=[*kept, *ends]
                )

    return marked.mapInArrow(predict, schema)


def drop_rejected(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """Documents whose language can be told, all columns as they were.

    Rejected are those without any letter, and those whose decoding is unreliable (see
    ``learned``) and whose text shows by itself that it is noise (see ``noisy``). Texts
    in languages without labels decode unreliably too, but aren't noise: they stay.
    Where fewer than two languages can be learned, every document with a letter stays.
    """
    names = ("__lang_pred", "__lang_score", "__lang_ambiguous")
    model, limit = learned(docs.filter(~held_out(F.col(doc_id))), text, label)
    if model is None:
        return docs.filter(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    return with_language(docs, model, text, names, limit).filter(F.col(names[0]) != UNDETERMINED).select(*[F.col(f"`{c}`") for c in docs.columns])
