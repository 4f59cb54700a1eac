"""All queries of this subpackage and the SQL of those that have one.

A module ``queries_<operator>`` offers QUERIES and SQL.
"""

import importlib
import pkgutil

import sparkloom.llm

QUERIES, SQL = {}, {}
for _found in sorted(m.name for m in pkgutil.iter_modules(sparkloom.llm.__path__) if m.name.startswith("queries_")):
    _module = importlib.import_module(f"sparkloom.llm.{_found}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
