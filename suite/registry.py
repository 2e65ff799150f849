"""Where the query modules register themselves."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def case(name: str, sql: str | None = None):
    def register(build):
        if name in QUERIES:
            raise ValueError(f"Duplicate query name {name}")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register
