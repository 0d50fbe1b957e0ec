"""All queries of the library itself, and their SQL."""

from __future__ import annotations

from millrace.plans import file_queries, relational_queries, report_queries, source_queries, surface_query, text_queries, tree_queries, usage_queries

_PARTS = (usage_queries, text_queries, relational_queries, source_queries, tree_queries, report_queries, file_queries)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()} | {"py_surface": surface_query.py_surface}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()} | {"py_surface": surface_query.SQL}
