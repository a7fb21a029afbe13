"""Runnable queries over the given tables, each with the SQL that checks it where there is one."""

from sluiceway.catalog import evaluation, facts, jobs, models, rows, sampling, tables  # noqa: F401
from sluiceway.catalog.registry import QUERIES, SQL, Query

__all__ = ["QUERIES", "SQL", "Query"]
