"""A training corpus from documents: tell the language, drop copies and near copies, pack.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept, and
returns a DataFrame; each result is written as Parquet and read again. All but
the last return the columns of ``documents``. SQL can't express a trained
classifier or the choice of cuts, so ORACLE_SQL is None and the tests hold the
stages against slow versions.
"""

import public_tokenizers

from sparkloom.llm.exact_dedup import drop_exact_copies
from sparkloom.llm.langid import drop_rejected
from sparkloom.llm.minhash import drop_near_copies
from sparkloom.llm.packing import pack
from sparkloom.llm.tables import table
from sparkloom.session import ship, written


def language(spark, docs, sf_dir):
    """Documents whose language can be told."""
    ship(spark)
    return drop_rejected(docs)


def exact(spark, docs, sf_dir):
    """The first document of each group of equal texts."""
    ship(spark)
    return drop_exact_copies(docs)


def near(spark, docs, sf_dir):
    """One document of each group of near copies, by shingles of five words."""
    ship(spark)
    return drop_near_copies(docs, width=5)


def packed(spark, docs, sf_dir):
    """Pieces of training sequences, with their ids."""
    ship(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("packed", packed)]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return written(STAGES[-1][1](spark, docs, sf_dir), "stage-packed")
