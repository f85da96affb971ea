"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from tidemark.plans import core_queries, node_queries, problem_queries

QUERIES = core_queries.QUERIES | node_queries.QUERIES | problem_queries.QUERIES
SQL = core_queries.SQL | node_queries.SQL | problem_queries.SQL
