"""Collects registered queries: a function of Fixtures and, where SQL can say it, the DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.plans.fixtures import PRELUDE, Fixtures

QUERIES: dict[str, Callable[[Fixtures], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query. sql is a SELECT over the prelude's fixtures (more common table expressions may come first, with `WITH`)."""

    def keep(f: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
        QUERIES[name] = f
        if sql:
            body = sql.strip()
            ORACLES[name] = PRELUDE + (", " + body[5:] if body.upper().startswith("WITH ") else body)
        return f

    return keep


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Fixtures(spark, sf_dir))) for name, f in QUERIES.items()}
