"""Registered queries: each reads whole tables through the operators, and has its SQL beside it."""

from __future__ import annotations

from . import data_queries, rule_queries

QUERIES = {**rule_queries.QUERIES, **data_queries.QUERIES}
ORACLE_SQL = {**rule_queries.ORACLE_SQL, **data_queries.ORACLE_SQL}
