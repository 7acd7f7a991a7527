"""Every registered query next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register ``f(spark, sf_dir)`` under its own name with its check SQL."""

    def register(f):
        QUERIES[name or f.__name__] = Query(f, sql)
        return f

    return register
