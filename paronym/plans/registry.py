"""Queries and SQL of the core."""

from __future__ import annotations

from . import feature_queries, lookup_queries, model_queries, packed_queries, pair_queries

_PARTS = (pair_queries, lookup_queries, packed_queries, model_queries, feature_queries)
QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL: dict[str, str] = {name: s for part in _PARTS for name, s in part.SQL.items()}
FLAGSHIP = "heuristic_top_pairs"
