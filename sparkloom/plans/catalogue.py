"""Queries over the driver's tables by name, and the SQL that must give the same rows."""

from __future__ import annotations

from sparkloom.plans import code_queries, graph_queries, guidance_queries, metric_queries, project_queries, rule_queries, symbol_queries, text_queries, workspace_queries
from sparkloom.plans.registry import Query

_PARTS = [text_queries, metric_queries, graph_queries, rule_queries, workspace_queries, code_queries, symbol_queries, guidance_queries, project_queries]
QUERIES: dict[str, Query] = {name: q for part in _PARTS for name, q in part.R.queries.items()}
ORACLES: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.R.oracles.items()}
