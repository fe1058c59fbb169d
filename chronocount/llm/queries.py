"""All queries of this subpackage."""

from __future__ import annotations

from chronocount.llm import canonical_queries, clusters_queries, leak_queries, lookalike_queries, mixing_queries, percentiles_queries, vectors_queries

_MODULES = (percentiles_queries, clusters_queries, vectors_queries, canonical_queries, leak_queries, mixing_queries, lookalike_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
