"""All registered queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import queries_ingest, queries_ledger, queries_loads, queries_process, queries_samples, queries_streams

MODULES = [queries_process, queries_ingest, queries_ledger, queries_samples, queries_streams, queries_loads]

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql.strip() for module in MODULES for name, sql in module.ORACLES.items()}
