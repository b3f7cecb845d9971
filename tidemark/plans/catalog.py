"""All registered queries and their oracles."""

from __future__ import annotations

from tidemark.plans import dependency_queries, file_queries, metric_queries, prepare_queries, run_queries, task_queries, temporal_queries
from tidemark.plans.data import nudged

MODULES = [temporal_queries, dependency_queries, prepare_queries, metric_queries, run_queries, task_queries, file_queries]

QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: nudged(sql) for m in MODULES for name, sql in m.ORACLES.items()}
