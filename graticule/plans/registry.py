"""The list of registered queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Runner
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, *covers: str, sql: str | None = None):
    """Register a query with the inventory rows it covers and its SQL counterpart."""
    def add(run: Runner) -> Runner:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")
        REGISTRY[name] = Query(name, covers, run, sql)
        return run

    return add
