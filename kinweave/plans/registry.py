"""Queries by name, each with its SQL twin where DuckDB can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        n = name or f.__name__
        if n in QUERIES:
            raise ValueError(f"two queries named {n}")
        QUERIES[n] = f
        if sql:
            SQL[n] = sql
        return f

    return add


#: The current standardized row of each record, in SQL.
STD = "std AS (SELECT * FROM int_std_records WHERE record_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record_key ORDER BY ingested_at DESC NULLS LAST, id DESC) = 1)"
#: The present entity of each record, in SQL.
MEMBERS = "mem AS (SELECT * FROM entity_membership WHERE record_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record_key ORDER BY assigned_at DESC NULLS LAST, id DESC) = 1)"
