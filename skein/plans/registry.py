"""All registered queries of the library's own operators, with their oracle SQL."""

from __future__ import annotations

from skein.plans import library_queries, mark_queries, ordered_queries, reading_queries, request_queries, rule_queries, sequential_queries, split_queries, table_queries

_MODULES = (ordered_queries, table_queries, library_queries, mark_queries, reading_queries, request_queries, rule_queries, sequential_queries, split_queries)
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
