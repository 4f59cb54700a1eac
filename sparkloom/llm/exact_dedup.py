"""Exact de-duplication by a heavy-hitter split, in DataFrame operations only.

A Misra-Gries summary (Spark's ``approx_top_k``, whose sketch is a mergeable
Misra-Gries counter set of fixed size) proposes the digests that may be
frequent. An exact count verifies them; the verified winners, at most
``MAX_WINNERS`` rows whatever the input, are broadcast, and rows of such a
digest are settled where they lie. All other digests are too rare to make a
partition uneven and go through an ordinary shuffle.

Defined results: a null text counts as empty; null doc_ids sort last; of rows
that share the smallest doc_id of a group (a repeated row) exactly one is kept;
an empty table gives an empty result; other columns are neither read nor
changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import written

#: Runs of this white space count as one space.
SPACE = r"[\x20\x09-\x0D]+"
#: Most digests that are broadcast, and counters of the summary. A digest with
#: more than about 3.5 / COUNTERS of the rows is proposed, unless MAX_WINNERS
#: others have more; what isn't proposed is shuffled, with the same results.
MAX_WINNERS = 1000
COUNTERS = 16384


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256))


def winners(keyed: DataFrame) -> DataFrame:
    """Frequent digests of (doc_id, tag, digest): digest, group_size and the row that stays."""
    summary = keyed.agg(F.expr(f"approx_top_k(xxhash64(digest), {MAX_WINNERS}, {COUNTERS})").alias("top"))
    proposed = summary.select(F.explode("top").alias("x")).select(F.col("x.item").alias("key"), F.col("x.count").alias("n")).filter("n > 1").select("key")
    return grouped(keyed.join(F.broadcast(proposed), F.xxhash64("digest") == F.col("key"), "left_semi")).filter("group_size > 1")


def order_of(doc_id: str = "doc_id", tag: str = "tag") -> Column:
    return F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), F.col(tag).alias("tag"))


def grouped(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(order_of()).alias("first"))


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keyed = written(docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("tag"), digest(F.col(text)).alias("digest")), "digests")
    frequent = F.broadcast(written(winners(keyed), "frequent-digests"))
    heavy = keyed.join(frequent, "digest").select("doc_id", "tag", "digest", "group_size", "first")
    same = Window.partitionBy("digest")
    light = keyed.join(frequent, "digest", "left_anti").select("doc_id", "tag", "digest", F.count(F.lit(1)).over(same).alias("group_size"), F.min(order_of()).over(same).alias("first"))
    return heavy.unionByName(light).select(
        "doc_id",
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("tag") == F.col("first.tag")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    Rows of a frequent digest leave where they lie, but for those that carry the
    id that stays; only the rest is shuffled.
    """
    columns = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    keyed = docs.select(row, F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("digest"))
    thin = written(keyed.select("doc_id", F.lit(0).alias("tag"), "digest"), "digests")
    frequent = F.broadcast(written(winners(thin).select("digest", F.col("first.id").alias("keep_id")), "frequent-digests"))
    left = keyed.join(frequent.select("digest", "keep_id", F.lit(True).alias("frequent")), "digest", "left").filter("frequent is null or doc_id <=> keep_id")
    place = F.row_number().over(Window.partitionBy("digest").orderBy(F.col("doc_id").asc_nulls_last()))
    return left.withColumn("place", place).filter("place = 1").select("row.*")
