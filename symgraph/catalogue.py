"""Registered queries and their oracle SQL, by name."""

from __future__ import annotations

from symgraph.plans import queries_csharp, queries_graph, queries_projects, queries_retrieval, queries_search, queries_sources, queries_streams, queries_tables  # noqa: F401
from symgraph.registry import ORACLES, QUERIES  # noqa: F401
