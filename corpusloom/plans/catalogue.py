"""Every registered query of the engine with its DuckDB counterpart."""

from __future__ import annotations

from . import graph_queries, guard_queries, metadata_queries, quality_queries, retrieval_queries, text_queries

PARTS = (text_queries, retrieval_queries, graph_queries, quality_queries, guard_queries, metadata_queries)
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
SQL = {name: sql for part in PARTS for name, sql in part.SQL.items()}
