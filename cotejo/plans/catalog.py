"""All queries of the engine: name -> (function, SQL or None)."""

from __future__ import annotations

from cotejo.plans import cell_queries, reconcile_queries, report_queries, spec_queries, usage_queries

CATALOG = {**reconcile_queries.QUERIES, **cell_queries.QUERIES, **spec_queries.QUERIES, **usage_queries.QUERIES, **report_queries.QUERIES}

QUERIES = {name: run for name, (run, _) in CATALOG.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in CATALOG.items() if sql}
