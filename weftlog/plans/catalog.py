"""All registered queries and their DuckDB equivalents."""

from __future__ import annotations

from weftlog.plans import event_queries, feature_queries, graph_queries, ingest_queries, link_queries, model_queries, run_queries, stat_queries, token_queries, window_queries  # noqa: F401  (they register)
from weftlog.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
