"""Queries that write the given tables to shards and read them again, and their SQL. Owner-specified: no reference lists them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkloom.session import shared_dir
from sparkloom.sources.shards import write_shards


def shards_by_length(spark, sf_dir):
    """Documents written to shards in the order of their length, and those of 2,000 characters or more read again from the shards that may hold any."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text", F.length("text").alias("length"))
    path = f"{shared_dir(spark)}/sparkloom/{spark.sparkContext.applicationId}/shards-{uuid.uuid4().hex[:12]}"
    table = write_shards(docs.repartitionByRange("length", "doc_id"), path)
    return table.filter(F.col("length") >= 2000).select("doc_id", "lang", "source", "length", F.sha2("text", 256).alias("text_sha256"))


QUERIES = {"shards_by_length": shards_by_length}
SQL = {
    "shards_by_length": """
        SELECT doc_id, lang, source, CAST(length(text) AS INTEGER) AS length, sha256(text) AS text_sha256 FROM documents WHERE length(text) >= 2000
    """
}
