"""Registration of queries: a function over the domain tables, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..adapters import SQL, Domain

#: The functions over the domain tables themselves: queries on one ``Domain`` share the tables that it stores.
ON_DOMAIN: dict[str, Callable[[Domain], DataFrame]] = {}
QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers ``function(domain) -> DataFrame`` under ``name``; ``sql`` goes on after the domain tables' WITH list."""

    def register(function: Callable[[Domain], DataFrame]) -> Callable:
        ON_DOMAIN[name] = function
        QUERIES[name] = lambda spark, sf_dir: function(Domain(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = SQL + sql
        return function

    return register
