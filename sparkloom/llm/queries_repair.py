"""Query op11_repair. SQL can't express the cheapest edits of least initials; its tests hold it against a search over all edits."""

from sparkloom.llm.repair import damaged, digests, repaired
from sparkloom.llm.tables import table


def op11_repair(spark, sf_dir):
    return digests(repaired(damaged(table(spark, sf_dir, "conversations"))))


QUERIES = {"op11_repair": op11_repair}
SQL = {}
