"""All queries of the library, and their SQL."""

from __future__ import annotations

from tessera.plans import audit_queries, distribution_queries, event_queries, profile_queries, run_queries, search_queries, session_queries, signal_queries, store_queries, text_queries

_ALL = [search_queries, run_queries, distribution_queries, profile_queries, event_queries, audit_queries, store_queries, text_queries, signal_queries, session_queries]
QUERIES = {name: query for module in _ALL for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _ALL for name, sql in module.SQL.items()}
