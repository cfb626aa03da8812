"""Operators for large text collections; nothing outside this subpackage imports them."""

from .queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
