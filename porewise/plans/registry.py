"""Queries by name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import adapters as ad

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the function under its name, with SQL after the adapters' tables ``f`` and ``bed``."""

    def add(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = f"with f as {ad.features_sql()}, bed as ({ad.BED}), {sql}" if sql.lstrip().startswith("x as") else f"with f as {ad.features_sql()}, bed as ({ad.BED}) {sql}"
        return run

    return add
