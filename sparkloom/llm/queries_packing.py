"""Query op6_packing. SQL can't express the choice of cuts; its tests hold it against a slow search and the tokenizer."""

import public_tokenizers

from sparkloom.llm.packing import pack
from sparkloom.llm.tables import table


def op6_packing(spark, sf_dir, path=None):
    return pack(table(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


QUERIES = {"op6_packing": op6_packing}
SQL = {}
