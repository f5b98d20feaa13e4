"""Operators of a large training-data pipeline, their queries and the SQL that checks them."""

from sylvagrid.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
