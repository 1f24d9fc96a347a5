"""Where the query modules register what they define."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.plans.ctes import with_ctes
from tidelog.sources.derive import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, uses: str = "", sql: str | None = None, recursive: bool = False):
    """Register ``fn(tables) -> DataFrame`` as ``name``; ``uses`` lists the derived logs that
    the SQL counterpart reads."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            whole = with_ctes(uses, sql) if uses else sql
            ORACLES[name] = whole.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else whole
        return fn

    return register
