"""All queries of the library with their SQL."""

from __future__ import annotations

from tallyweave.operators import domain_queries, printed_queries, text_queries, workflow_queries
from tallyweave.plans import reports

MODULES = (reports, text_queries, domain_queries, printed_queries, workflow_queries)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
