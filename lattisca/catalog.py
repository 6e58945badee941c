"""All queries of the library's own operators, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "filtered_sequences"
_FOUND: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with SQL that gives the same rows."""

    def keep(f: Query) -> Query:
        _FOUND[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    from lattisca import plans

    plans.load()
    return dict(_FOUND)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
