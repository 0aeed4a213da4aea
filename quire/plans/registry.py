"""All queries of the document operators and their DuckDB SQL."""

from __future__ import annotations

from quire.plans import details, oracle, queries

QUERIES = queries.QUERIES | details.QUERIES
ORACLE_SQL = oracle.ORACLE_SQL | details.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
