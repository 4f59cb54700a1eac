"""Query op13_fingerprints. SQL can't express the digest; its tests hold it against plain loops over one sorted list."""

from sparkloom.llm.fingerprints import with_next
from sparkloom.llm.tables import table


def op13_fingerprints(spark, sf_dir):
    return with_next(table(spark, sf_dir, "documents"))


QUERIES = {"op13_fingerprints": op13_fingerprints}
SQL = {}
