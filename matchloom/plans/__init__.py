"""The catalogue of queries and the SQL that must give the same rows."""

from __future__ import annotations

from matchloom.plans import feeds, jobs, readport, reconcile, records, store, training

_MODULES = (records, readport, feeds, reconcile, store, jobs, training)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
FLAGSHIP = "latest_state"
