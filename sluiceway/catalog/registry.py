"""Registry of queries and of the tables' stand-in roles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.functions import category_map
from sluiceway.functions.parsing import as_column

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its check."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Six decimals in double arithmetic; ``round`` would go through decimals, row by row."""
    return F.rint(as_column(c) * F.lit(1e6)) / F.lit(1e6)


# The event types play the attack categories.
EVENT_GROUPS = {
    "normal": ["view"], "probe": ["click"], "dos": ["error"], "r2l": ["purchase"],
    "u2r": ["signup"],
}
EVENT_CATEGORY_SQL = (
    "case event_type when 'view' then 'normal' when 'click' then 'probe' when 'error' then 'dos' "
    "when 'purchase' then 'r2l' when 'signup' then 'u2r' else 'unknown' end"
)


def events_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn(
        "attack_category", category_map("event_type", EVENT_GROUPS, identity=())
    )
