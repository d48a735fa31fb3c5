"""Registry of runnable queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    key: str
    covers: tuple[str, ...]
    run: Runner
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(key: str, covers: str, sql: str | None = None):
    """Register a query; ``covers`` names the inventory rows it implements."""

    def register(run: Runner) -> Runner:
        if key in CATALOG:
            raise ValueError(f"query {key} is registered twice")
        CATALOG[key] = Query(key, tuple(covers.split()), run, sql)
        return run

    return register
