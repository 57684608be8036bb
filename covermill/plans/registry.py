"""Registered queries: each job over the given tables, with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covermill.plans.oracle_views import with_views
from covermill.session import prepare
from covermill.sources.domain import DomainTables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Registers a job that maps the domain tables to a result."""

    def wrap(job: Callable[[DomainTables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return job(DomainTables(prepare(spark), folder))

        run.__name__ = name
        run.__doc__ = job.__doc__
        _QUERIES[name] = run
        if sql:
            _SQL[name] = sql if sql in _SQL.values() else with_views(sql)
        return job

    return wrap


def oracle_of(name: str) -> str:
    """The check SQL of a query registered before, for another way to the same result."""
    return _SQL[name]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- result shapes both engines agree on -----------------------------------------------------------


def joined(col: str | Column, sep: str = "|") -> Column:
    return F.array_join(col, sep)


def day(col: str) -> Column:
    return F.date_format(col, "yyyy-MM-dd")


def instant(col: str) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def big(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("bigint")
