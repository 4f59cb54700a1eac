"""Near-duplicate documents by an inverted join over MinHash coordinates.

1. One pass over the texts makes each document's set of word shingles, its
   size, a 128-bit key of the set and ``COORDINATES`` minima. Documents with
   equal sets become one representative; only representatives go on.
2. Every coordinate-value pair is a posting. Two sets whose similarity reaches
   the limit collide in at least ``MATCHES`` coordinates (see below), so they
   share one of the ``COORDINATES - MATCHES + 1`` rarest postings of each
   (prefix): the others are skipped, as are postings of a single document.
   Passages that many documents share make frequent postings, which prefixes
   leave out.
3. In ``ROUNDS`` rounds, each with another order, the first document of a
   posting leads it, and every document is compared with the ``LEADS`` ones that
   lead most of its postings. Colliding coordinates are counted; pairs with ``MATCHES`` or more are confirmed on full sets.
   Confirmed links give components.
4. What is left are pairs of documents that share a posting but no component,
   such as the pages of one template that are alike but not near enough: all
   pairs of them may collide. They are told apart by prefixes again, now of
   their full sets: with shingles ordered from those of one component over rare
   to frequent ones, two sets of n and m that link share a shingle among the
   first n - o + 1 and m - o + 1, where o is the least intersection that sizes
   n and m allow. Sizes are put into bands, and a set's prefix is as long as a
   partner's band needs, so shingles that all pages of a template share are
   left out of it where each page has enough of its own; and two pages that both
   have more of their own than half of what linked ones may differ by, are never
   tried. Of two documents that
   share a posting at least one lies outside its main component; those are
   joined with the others by (bands, shingle). Parities bound from below how far
   two sets differ; pairs that they allow are confirmed on full sets. Pairs
   inside a component are never compared.

A pair whose similarity is exactly the limit 0.8 collides in 51.2 of 64
coordinates on average with a deviation of 3.2; fewer than 39 has a chance of
about 5 in 100,000 and less for nearer pairs. Nothing else loses a link.

Defined results: a null text counts as empty; an empty set links with nothing;
rows that repeat a doc_id keep their own places and one row of a component is
kept; null doc_ids sort last; an empty table gives an empty result; other
columns are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrow_text import text_slices
from sparkloom.llm.components import components
from sparkloom.session import written

COORDINATES, MATCHES, ROUNDS, LEADS, PARITIES = 64, 39, 3, 4, 8
#: A band holds sizes up to so many times its least.
BAND = 1.05
#: Links need LEAST_OF * intersection >= LEAST * union.
LEAST, LEAST_OF = 80, 100
WORDS = 4
PIECE = 1 << 20

_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**64, 256, dtype=_U, endpoint=False)
_PLACE = _rng.integers(1, 2**64, 8, dtype=_U, endpoint=False) | _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_MUL = _rng.integers(1, 2**64, COORDINATES, dtype=_U, endpoint=False) | _U(1)
_XOR = _rng.integers(0, 2**64, COORDINATES, dtype=_U, endpoint=False)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE[65:91] = _BYTE[97:123]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE)
    p[:1] = 1
    return np.multiply.accumulate(p)


_POWER = _powers(64)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words among the bytes, with A-Z in lower case, and where each begins."""
    gap = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.zeros(0, _U), begin
    global _POWER
    size = end - begin
    if (longest := int(size.max())) > len(_POWER):
        _POWER = _powers(longest)
    start = np.cumsum(size) - size
    inside = np.arange(int(size.sum())) - np.repeat(start, size)
    part = _BYTE[data[~gap]] * _POWER[inside]
    return mix(np.add.reduceat(part, start) + size.astype(_U) * _PLACE[5]), begin


def hashes_of(data: np.ndarray) -> np.ndarray:
    """Word hashes of one text of any length, in pieces that end at white space."""
    if len(data) <= PIECE:
        return word_hashes(data)[0]
    out, lo = [], 0
    while lo < len(data):
        hi = min(len(data), lo + PIECE)
        while hi < len(data) and not _SPACE[data[hi]]:
            hi += 1
        out.append(word_hashes(data[lo:hi])[0])
        lo = hi
    return np.concatenate(out)


def shingle_set(words: np.ndarray, width: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than ``width`` make one shingle."""
    if not len(words):
        return words
    k = min(width, len(words))
    total = np.full(len(words) - k + 1, _U(k) * _PLACE[6])
    for i in range(k):
        total += words[i : len(words) - k + 1 + i] * _PLACE[i % 5] ^ _PLACE[i % 5] >> _U(i + 1)
    return np.unique(mix(total))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each coordinate's hash over a set, 64 bits each."""
    out = np.full(COORDINATES, _U(2**64 - 1))
    for lo in range(0, len(shingles), 4096):
        part = shingles[lo : lo + 4096]
        h = (part[None, :] ^ _XOR[:, None]) * _MUL[:, None]
        h ^= h >> _U(32)
        h *= _U(0xD6E8FEB86659FD93)
        np.minimum(out, h.min(1), out=out)
    return out


def _sets(batch: pa.RecordBatch, text: str, width: int) -> Iterator[tuple[int, np.ndarray]]:
    for lo, hi, data, at in text_slices(batch, text):
        if hi - lo == 1:
            yield lo, shingle_set(hashes_of(data), width)
            continue
        # one white space between texts keeps their words apart
        apart = np.full(len(data) + hi - lo, 32, np.uint8)
        apart[np.arange(len(data)) + np.repeat(np.arange(hi - lo), np.diff(at))] = data
        words, begin = word_hashes(apart)
        cut = np.searchsorted(begin, at + np.arange(hi - lo + 1))
        for i in range(hi - lo):
            yield lo + i, shingle_set(words[cut[i] : cut[i + 1]], width)


def signatures(docs: DataFrame, text: str, width: int) -> DataFrame:
    """doc_id, tag, key_a, key_b, n_shingles and the coordinates (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, coordinates = [], [], []
            for _, s in _sets(batch, "text", width):
                n.append(len(s))
                keys.append((int(mix(s).sum(dtype=_U)), int(mix(s + _PLACE[7]).sum(dtype=_U))))
                coordinates.append(minima(s).view(np.int64) if len(s) else None)
            a, b = (np.array([k[i] for k in keys], _U).view(np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tag"), batch.column("text_key"), pa.array(a), pa.array(b), pa.array(n, pa.int64()), pa.array(coordinates, pa.list_(pa.int64()))],
                names=["doc_id", "tag", "text_key", "key_a", "key_b", "n_shingles", "coordinates"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "tag", F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        run, f"doc_id {kind}, tag long, text_key long, key_a long, key_b long, n_shingles long, coordinates array<long>"
    )


def parities(shingles: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITIES bins whether it holds an odd number of shingles, 64 to a number.

    Two sets differ in at least as many shingles as bits of their parities.
    """
    return np.packbits((np.bincount((shingles % _U(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1).astype(bool)).view(np.int64)


def full_sets(texts: DataFrame, width: int) -> DataFrame:
    """rep, its whole set of shingles and the parities, from (rep, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, s in _sets(batch, "text", width)]
            longs = lambda x: pa.array([y.view(np.int64) for y in x], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), longs(sets), longs(map(parities, sets))], names=["rep", "shingles", "parities"])

    return texts.select("rep", "text").mapInArrow(run, "rep long, shingles array<long>, parities array<long>")


def collisions(x: Column, y: Column) -> Column:
    """Coordinates in which two documents agree; a value holds for its own coordinate only."""
    return F.size(F.array_intersect(x, y))


def postings(reps: DataFrame) -> DataFrame:
    """(posting, rep): the rarest postings of each representative, as many as a pair needs, without those of one document."""
    each = reps.select("rep", F.explode("coordinates").alias("posting"))
    shared = each.groupBy("posting").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    counted = each.join(shared.hint("shuffle_hash"), "posting").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "posting"))).alias("all"))
    # postings of one document are the rarest and come first in a prefix
    room = F.lit(COORDINATES - MATCHES + 1) - (F.lit(COORDINATES) - F.size("all"))
    return counted.filter(room > 0).select("rep", F.explode(F.slice("all", F.lit(1), room)).alias("p")).select("rep", "p.posting")


def led(posts: DataFrame, turn: int) -> DataFrame:
    """Pairs of each document with the LEADS ones that come first, in the order of this turn, in most of its postings."""
    order = F.struct(F.xxhash64("rep", F.lit(turn)).alias("o"), F.col("rep").alias("lead"))
    first = posts.groupBy("posting").agg(F.min(order).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("posting", "f")
    shared = posts.join(first, "posting").filter("rep <> f.lead").groupBy("rep", "f").agg(F.count(F.lit(1)).alias("n"))
    most = F.sort_array(F.collect_list(F.struct("n", F.bitwise_not("f.o").alias("o"), "f.lead")), asc=False)
    best = shared.groupBy("rep").agg(F.slice(most, 1, LEADS).alias("m")).select("rep", F.explode("m.lead").alias("lead"))
    return best.select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b"))


def with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Pairs with ``column`` of either end, as x and y."""
    return pairs.join(table.select(F.col("rep").alias("a"), F.col(column).alias("x")), "a").join(table.select(F.col("rep").alias("b"), F.col(column).alias("y")), "b")


def matching(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs that collide in MATCHES coordinates or more."""
    return with_both(pairs, reps, "coordinates").filter(collisions(F.col("x"), F.col("y")) >= MATCHES).select("a", "b")


def sets_of(asked: DataFrame, reps: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Whole sets of the representatives in ``asked``, from their texts."""
    where = asked.select("rep").distinct().join(reps.select("rep", F.col("first_id").alias("id"), F.col("text_key").alias("key")), "rep")
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").join(where, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")))
    return full_sets(texts.select("rep", "text"), width).dropDuplicates(["rep"])


def confirmed(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The pairs that are links, by their whole sets."""
    both, total = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    return with_both(pairs, sets, "shingles").filter(least[1] * both >= least[0] * (total - both)).select("a", "b")


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WORDS, least: tuple[int, int] = (LEAST, LEAST_OF)) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, and the row's number and text hash."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("tag"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = written(signatures(docs, "text", width), "signatures")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("tag").alias("tag"), F.col("text_key").alias("key"))
    key = ["key_a", "key_b", "n_shingles"]
    first = rows.filter("n_shingles > 0").groupBy(*key).agg(F.min(order).alias("first"), F.first("coordinates").alias("coordinates"))
    reps = written(first.select(*key, F.col("first.tag").alias("rep"), F.col("first.id").alias("first_id"), F.col("first.no_id").alias("no_id"), F.col("first.key").alias("text_key"), "coordinates"), "representatives")
    posts = written(postings(reps), "postings")

    sets = written(sets_of(posts, reps, docs, width), "sets")

    turns = led(posts, 0)
    for turn in range(1, ROUNDS):
        turns = turns.unionByName(led(posts, turn))
    links = written(confirmed(written(matching(turns.distinct(), reps), "pairs"), sets, least), "links")
    roots = written(components(links), "roots")
    left = written(prefixes(mixed(posts, roots), sets, least), "prefixes")
    more = written(confirmed(written(across(left, least), "pairs"), sets, least), "links")
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    return settled(rows, reps, roots, key)


def mixed(posts: DataFrame, roots: DataFrame) -> DataFrame:
    """(rep, root, asks) of representatives with a posting in more than one component; ``asks``: it lies outside the main one of some posting."""
    placed = posts.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("posting", "rep", F.coalesce("root", "rep").alias("root"))
    sizes = placed.groupBy("posting", "root").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("posting").agg(F.max(F.struct("n", "root")).alias("m"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").select("posting", F.col("m.root").alias("main"))
    return placed.join(main, "posting").groupBy("rep", "root").agg(F.max(F.col("root") != F.col("main")).alias("asks"))


def band(n: Column) -> Column:
    """The band of a size; larger sizes never have a lower band."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(BAND))).cast("int")


def overlap(n: Column, m: Column, least: tuple[int, int]) -> Column:
    """The least intersection of sets of n and m that link."""
    return F.ceil(least[0] * (n + m) / F.lit(sum(least))).cast("long")


def prefixes(asked: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(rep, root, asks, n, own, other, poor, to_poor, shingle, place, parities): for each band ``other`` of partners the prefix of a set, by places in the order of shingles.

    Shingles of one component come first in that order, and meet no other component.
    A set is poor if it holds more of these than half of what two sets of its size
    that link may differ by. Two poor sets never link, so a poor one asks rich ones
    only (``to_poor`` is false), a rich one asks both.
    """
    full = sets.join(asked, "rep").select("rep", "root", "asks", F.size("shingles").cast("long").alias("n"), "shingles", "parities")
    each = full.select("rep", "root", F.explode("shingles").alias("shingle"))
    shared = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("f"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("shingle", "f")
    met = each.join(shared, "shingle").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("f", "shingle"))).alias("met"))
    n, place = F.col("n"), F.col("place")
    # partners hold between least[0] / least[1] and least[1] / least[0] times as many
    low, high = band(F.ceil(n * least[0] / F.lit(least[1]))), band(F.floor(n * least[1] / F.lit(least[0])))
    smallest = lambda b: F.greatest(F.lit(1), F.floor(F.pow(F.lit(BAND), b)) - 1).cast("long")
    first = n - F.size("met")
    longest = n - overlap(n, smallest(low), least) + 1 - first
    poor = first * sum(least) > n * (least[1] - least[0])
    placed = (
        full.select("rep", "root", "asks", "n", "parities")
        .join(met, "rep")
        .filter(longest > 0)
        .select("rep", "root", "asks", "n", "parities", poor.alias("poor"), first.alias("first"), F.slice(F.col("met")["shingle"], F.lit(1), F.greatest(longest, F.lit(0)).cast("int")).alias("met"))
        .select("*", F.posexplode("met").alias("k", "shingle"))
        .select("rep", "root", "asks", "n", "poor", (F.col("first") + F.col("k")).alias("place"), "shingle", "parities")
    )
    others = F.filter(F.sequence(low, high), lambda b: place <= n - overlap(n, smallest(b), least))
    asked_for = F.when(F.col("poor"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    banded = placed.select("rep", "root", "asks", "n", band(n).alias("own"), F.explode(others).alias("other"), "poor", "shingle", "place", "parities")
    return banded.select("*", F.explode(asked_for).alias("to_poor"))


def across(left: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Pairs of different components that share a shingle of their prefixes early enough and may link by their parities; of ``left``, those that ask and all others."""
    x = left.filter("asks").select("shingle", F.col("own").alias("x_own"), F.col("other").alias("x_other"), F.col("poor").alias("x_poor"), F.col("to_poor").alias("x_to_poor"), F.col("rep").alias("x"), F.col("root").alias("x_root"), F.col("n").alias("x_n"), F.col("place").alias("x_place"), F.col("parities").alias("x_parities"))
    y = left.select("shingle", "own", "other", "poor", "to_poor", "rep", "root", "asks", "n", "place", "parities")
    o = overlap(F.col("x_n"), F.col("n"), least)
    early = (F.col("x_place") <= F.col("x_n") - o) & (F.col("place") <= F.col("n") - o)
    apart = (F.col("x_root") != F.col("root")) & (~F.col("asks") | (F.col("x") < F.col("rep")))
    # the parities of sets that link differ in no more bits than the sets in shingles
    bits = F.expr(" + ".join(f"bit_count(x_parities[{i}] ^ parities[{i}])" for i in range(PARITIES)))
    allowed = bits * sum(least) <= (F.col("x_n") + F.col("n")) * (least[1] - least[0])
    sizes = (F.col("x_own") == F.col("other")) & (F.col("x_other") == F.col("own")) & (F.col("x_poor") == F.col("to_poor")) & (F.col("x_to_poor") == F.col("poor"))
    found = x.join(y, (x["shingle"] == y["shingle"]) & sizes & apart & early & allowed)
    return found.select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b")).distinct()


def settled(rows: DataFrame, reps: DataFrame, roots: DataFrame, key: list[str]) -> DataFrame:
    """Each row's component, and whether it is the row that stays."""
    rooted = reps.select(*key, "rep", F.struct("no_id", F.col("first_id").alias("id"), F.col("rep").alias("tag")).alias("first")).join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    placed = rooted.join(least, "root").select(*key, "least")
    joined = rows.select("doc_id", "tag", "text_key", *key).join(placed, key, "left")
    return joined.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.id")).alias("component_id"),
        F.coalesce(F.col("tag") == F.col("least.tag"), F.lit(True)).alias("kept"),
        "tag",
        "text_key",
    )


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WORDS, least: tuple[int, int] = (LEAST, LEAST_OF)) -> DataFrame:
    """``docs`` with one document of each component, all columns as they were.

    Whole repeats of a kept row, in id and text, stay with it; exact
    de-duplication removes those.
    """
    found = near_groups(docs, text, doc_id, width, least)
    dropped = written(found.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.max("kept").alias("kept")).filter("not kept").select("__id", "__key"), "dropped")
    same = docs[doc_id].eqNullSafe(dropped["__id"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == dropped["__key"])
    return docs.join(dropped, same, "left_anti")
