"""All registered queries over the change log, with their SQL counterparts."""

from __future__ import annotations

from tideline.plans import capture_queries, delivery_queries, state_queries, stats_queries

_ALL = capture_queries.QUERIES | state_queries.QUERIES | delivery_queries.QUERIES | stats_queries.QUERIES
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items()}
