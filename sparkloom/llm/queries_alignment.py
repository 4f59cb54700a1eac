"""Query op12_alignment. SQL can't run a tokenizer; its tests hold it against plain loops over whole texts."""

import public_tokenizers

from sparkloom.llm.alignment import aligned
from sparkloom.llm.tables import table


def op12_alignment(spark, sf_dir, a=None, b=None):
    return aligned(table(spark, sf_dir, "documents"), a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op12_alignment": op12_alignment}
SQL = {}
