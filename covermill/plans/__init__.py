"""Registered queries."""

from covermill.plans import jobs_core, jobs_domain, jobs_ml, jobs_streams  # noqa: F401
from covermill.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
