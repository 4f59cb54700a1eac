"""Query op1_bpe. SQL can't express merges; its tests hold it against the tokenizer library."""

import public_tokenizers

from sparkloom.llm.bpe import digests
from sparkloom.llm.tables import table


def op1_bpe(spark, sf_dir, path=None):
    return digests(table(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op1_bpe": op1_bpe}
SQL = {}
