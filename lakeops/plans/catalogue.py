"""Registry of named queries: Spark callable plus DuckDB oracle SQL.

Each registered query reads the supplied tables in ``sf_dir`` (through the
fixture views) and returns a DataFrame.  ``sql`` is the independent DuckDB
statement over the same tables; ``None`` marks a query whose semantics SQL
cannot state (streams, sequential SQL cells).  Fixture CTEs are prefixed to
the oracle text automatically.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeops.fixtures import with_fixtures

QueryFn = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _load() -> None:
    from lakeops.plans import (q_access, q_activity, q_catalog, q_exprs, q_notebooks,  # noqa: F401
                               q_registry, q_streams, q_tables)


def queries() -> dict[str, QueryFn]:
    _load()
    return {k: fn for k, (fn, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: with_fixtures(sql) for k, (_, sql) in _REGISTRY.items() if sql is not None}
