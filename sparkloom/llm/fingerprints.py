r"""Document fingerprints: quartile bucket digests of byte triplets.

Every three consecutive bytes of a text, with two marks before its first and
after its last byte, are hashed into one of 256 buckets. A bucket's count is
encoded by the quartile of all counts that it lies in (0 to 3), which keeps the
shape of the distribution and forgets the length; the length is encoded beside
it in eighths of a doubling. A fingerprint is text: four hexadecimal digits of
length, then two bits a bucket.

Two digests differ by the summed distance of their quartiles, divided by what
two digests with the same shares of quartiles differ by if their buckets agree
only by chance, plus a tenth for each doubling of length (three tenths at most).
The score is held to at most 1, so likeness, 1 less the score, lies in 0 to 1:
equal digests have 1, unrelated ones about 0, whatever their length.

``with_next`` gives each document the start of the next one by doc_id without
one task that sees all rows: documents are dealt into ranges of doc_id whose
limits come from approximate quantiles, the first document of each range is
sent along with the range before it too, and each range is sorted and read as a
stream. So texts are shuffled once; what is collected to the driver is one limit
and one id a range. Ranges cover all rows, however their limits fall.

Defined results: a null text counts as empty, an empty text has a fingerprint
of its own; rows without a doc_id come first; rows of equal doc_id, which share
a range, follow one another by their texts (repeated rows are each other's next
document); the last row is followed by the first, a single row by itself; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

BUCKETS = 256
#: Bytes that are counted at a time, so that memory doesn't grow with a text.
SLICE = 1 << 20
#: Ranges of doc_id for each shuffle partition.
RANGES = 16
#: Odd multipliers of the hash of a triplet.
MIX = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)
_DISTANCE = np.abs(np.arange(4)[:, None] - np.arange(4))


def counts(data: bytes) -> np.ndarray:
    """Triplets of each bucket."""
    total = np.zeros(BUCKETS, np.int64)
    if not data:
        return total
    marked = np.concatenate(([256, 256], np.frombuffer(data, np.uint8), [257, 257])).astype(np.uint16)
    for at in range(0, len(marked) - 2, SLICE):
        x = marked[at : at + SLICE + 2].astype(np.uint32)
        a, b, c = x[:-2], x[1:-1], x[2:]
        mixed = (a * MIX[0] + b * MIX[1] + c * MIX[2]) ^ ((a * MIX[1] + b * MIX[2] + c * MIX[0]) >> np.uint32(15))
        total += np.bincount((mixed * MIX[3]) >> np.uint32(24), minlength=BUCKETS)
    return total


class Digest:
    """Quartiles of the buckets and the level of the length."""

    __slots__ = ("codes", "level", "shares")

    def __init__(self, codes: np.ndarray, level: int):
        self.codes, self.level, self.shares = codes, level, np.bincount(codes, minlength=4)

    @classmethod
    def of(cls, text: str) -> Digest:
        data = text.encode("utf-8", "surrogatepass")
        n = counts(data)
        low, middle, high = np.sort(n)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
        return cls((n > low).astype(np.int8) + (n > middle) + (n > high), round(8 * np.log2(1 + len(data))))

    @classmethod
    def read(cls, written: str) -> Digest:
        packed = np.frombuffer(bytes.fromhex(written[4:]), np.uint8)
        return cls(((packed[:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3).astype(np.int8).ravel(), int(written[:4], 16))

    def __str__(self) -> str:
        quads = self.codes.reshape(-1, 4).astype(np.uint8)
        return f"{self.level:04x}" + (quads[:, 0] << 6 | quads[:, 1] << 4 | quads[:, 2] << 2 | quads[:, 3]).astype(np.uint8).tobytes().hex()


def difference(a: Digest, b: Digest) -> float:
    """0 for equal digests, at most 1; the same both ways."""
    apart = int(np.abs(a.codes - b.codes).sum())
    chance = float((_DISTANCE * np.outer(a.shares, b.shares)).sum()) / BUCKETS
    return min(1.0, (apart / chance if chance else float(apart > 0)) + min(0.3, abs(a.level - b.level) / 80))


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints, about 0 for those of unrelated texts."""
    return 1.0 - difference(Digest.read(a), Digest.read(b))


@F.pandas_udf(StringType())
def fingerprint(text: pd.Series) -> pd.Series:
    """The fingerprint of each text; a null counts as empty."""
    return text.map(lambda t: str(Digest.of(t or "")))


@F.pandas_udf(DoubleType())
def likeness_of(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two columns of fingerprints; null if either is null."""
    return pd.Series([None if x is None or y is None else likeness(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def in_ranges(docs: DataFrame, key: Column, ranges: int | None = None) -> DataFrame:
    """(range, closing, doc_id, key, text) of every document, and a closing row for each range that holds any.

    It has the text of the first document of the next such range, in the last range of the first one.
    """
    kind = dict(docs.dtypes)["doc_id"]
    ranges = ranges or RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id"), key.alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    limits = docs.select(F.percentile_approx(key, shares, max(10_000, 10 * ranges)).alias("at")).first()["at"] or []
    limits = sorted(set(limits)) if ranges > 1 else []

    @F.pandas_udf("int")
    def place(at: pd.Series) -> pd.Series:
        # a null comes before all limits
        return at.map(lambda k: 0 if pd.isna(k) else 1 + bisect_right(limits, k)).astype("int32")

    dealt = rows.withColumn("range", place("key"))
    known, missing = F.min("key").alias("key"), F.max(F.col("key").isNull()).alias("missing")
    # one row a range: a range with a null begins with it
    firsts = sorted((r["range"], None if r["missing"] else r["key"]) for r in dealt.select("range", "key").groupBy("range").agg(known, missing).collect())
    closes = docs.sparkSession.createDataFrame([(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)], "first_key long, closed int")
    closing = (
        rows.join(F.broadcast(closes), F.col("key").eqNullSafe(F.col("first_key")))
        .groupBy(F.col("closed").alias("range"))
        .agg(F.min("text").alias("text"))
        .select("range", F.lit(True).alias("closing"), F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("long").alias("key"), "text")
    )
    return dealt.select("range", F.lit(False).alias("closing"), "doc_id", "key", "text").unionByName(closing)


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text has its last quarter (rounded down, in code points) replaced by as many of the first code points of
    the next document, or all it has. doc_id has to be a whole number.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = in_ranges(docs, F.col("doc_id").cast("long"), ranges)
    ordered = rows.repartition("range").sortWithinPartitions("range", "closing", "key", "text").select("range", "doc_id", "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def followed(held: tuple, text: str, own: Digest) -> tuple:
        key, before, digest = held
        part = len(before) // 4
        edited = before[: len(before) - part] + text[:part]
        changed = digest if edited == before else Digest.of(edited)
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return key, len(before), sha, str(digest), str(changed), 1.0 - difference(digest, changed), 1.0 - difference(digest, own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, None
        for batch in batches:
            found = []
            for row in zip(*(batch.column(c) for c in ("range", "doc_id", "text")), strict=True):
                place, key, text = (v.as_py() for v in row)
                own = Digest.of(text)
                if place == at:
                    found.append(followed(held, text, own))
                held, at = (key, text, own), place
            columns = list(zip(*found, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k or batch.column("doc_id").type) for c, k in zip(columns, kinds, strict=True)], names=names)

    return ordered.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
