"""The registered queries and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tallyforge.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, folder) under its name; the views of the query before it are let go."""
    def register(f):
        @wraps(f)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            views.free()
            return f(spark, folder)

        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register
