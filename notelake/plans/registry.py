"""Where the queries of the catalog and their SQL are put down."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from notelake.plans import inputs as I

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _with(sql: str) -> str:
    """Put the views that a statement names before its own."""
    used = {v for v in I.VIEWS if v in sql}
    used |= {v for v in I.VIEWS if any(v in I.VIEWS[u] for u in used)}
    if not used:
        return sql
    head, rest = ("with recursive", sql.removeprefix("with recursive")) if sql.startswith("with recursive") else ("with", sql.removeprefix("with ")) if sql.startswith("with ") else ("with", None)
    views = ", ".join(f"{v} as ({I.VIEWS[v]})" for v in I.VIEWS if v in used)
    return f"{head} {views}, {rest}" if rest is not None else f"{head} {views} {sql}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = _with(sql.strip())
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
