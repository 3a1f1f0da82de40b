"""All registered queries of the review library, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.sources.views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Register a query, and the SQL over the named views that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = with_views(" ".join(sql.split("\n")).strip(), *views)
        return f

    return add


def load() -> None:
    """Import the modules that register queries."""
    from strandline.plans import corpus, events, findings, review, vectors  # noqa: F401


load()
