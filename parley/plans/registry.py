"""All registered queries: a name, a function of (spark, sf_dir), and the SQL it must match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with its oracle."""

    def add(f: Query) -> Query:
        _QUERIES[name] = (f, sql)
        return f

    return add


def _load() -> None:
    from . import audit, decisions, exports, files, ledger, recovery, relations, scalars, structure, temporal, textual  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: s for k, (_, s) in _QUERIES.items() if s}
