"""All queries of the core library."""

from __future__ import annotations

from chronocount.plans import compare_queries, counts_queries, dynamics_queries, mixture_queries, more_queries, network_queries, packed_queries

_MODULES = (counts_queries, compare_queries, mixture_queries, network_queries, dynamics_queries, more_queries, packed_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
