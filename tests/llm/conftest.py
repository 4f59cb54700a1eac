import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """A documents table of (doc_id, text) or (doc_id, text, lang) rows, with more columns whose names results or steps have too."""

    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "src", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(parts)
        clash = ["kept", "tag", "digest", "rep", "score", "first", "group_size", "key", "text_key", "root", "n", "words"]
        return df.select("*", *[F.lit(f"own {c}").alias(c) for c in clash])

    return make


@pytest.fixture(scope="session")
def prose():
    """Texts of invented words, each by a seed."""

    def make(seed, n=60):
        r = random.Random(seed)
        return " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(n))

    return make


ODD = [None, "", " ", "\n\t ", "a", "A", "é", "日本", "\x00", "!!", "the the the the the", "x" * 200_000, "word " * 20_000]


@pytest.fixture
def odd():
    return list(enumerate(ODD)) + [(3, "\n\t "), (None, "no id"), (None, "no id")]
