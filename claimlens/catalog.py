"""All queries of the claims engine, and the DuckDB SQL of each."""

from __future__ import annotations

from .plans import QUERIES, ORACLE_SQL  # noqa: F401
