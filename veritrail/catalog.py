"""The named queries of the engine, and for each the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import extract, review, search

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (extract, search, review)


def queries() -> dict[str, Query]:
    return {q.__name__: q for m in _MODULES for q in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
