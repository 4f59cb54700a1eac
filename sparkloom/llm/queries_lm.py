"""Query op3_lm. SQL can't express a trained network; its tests hold it against a slow version."""

from sparkloom.llm.lm import pseudo_likelihood
from sparkloom.llm.tables import table


def op3_lm(spark, sf_dir):
    return pseudo_likelihood(table(spark, sf_dir, "documents"))


QUERIES = {"op3_lm": op3_lm}
SQL = {}
