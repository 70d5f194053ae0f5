"""Registry of named queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.sources.tables import SQL_VIEWS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True) -> Callable[[Query], Query]:
    """Register a query; `sql` goes on after the market views' WITH clause if `views`."""

    def put(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"query {f.__name__} is there already")
        QUERIES[f.__name__] = f
        if sql is not None:
            text = sql.strip()
            if views:
                text = f"WITH RECURSIVE {SQL_VIEWS}" + (f", {text[5:]}" if text[:5].upper() == "WITH " else f" {text}")
            ORACLES[f.__name__] = text
        return f

    return put
