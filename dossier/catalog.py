"""All registered queries of the engine and their DuckDB equivalents."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

from dossier.plans import collection, compare, ledger, pages, releases, scalars, stamps, text

PLANS = (text, pages, releases, stamps, compare, ledger, scalars, collection)
QUERIES = {name: query for plan in PLANS for name, query in plan.QUERIES.items()}
ORACLE = {name: sql for plan in PLANS for name, sql in plan.ORACLE.items()}

for _name, _module in list(sys.modules.items()):  # workers get the engine's functions by value and need no copy of it
    if _name.startswith("dossier.") and not _name.startswith("dossier.llm"):
        cloudpickle.register_pickle_by_value(_module)
