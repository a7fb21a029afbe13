"""Joins by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.parsing import as_column

def attach_row(df: DataFrame, row: DataFrame, name: str) -> DataFrame:
    """Add a one-row table (an aggregate) to every row as a struct column.

    It is a scalar subquery: computed once, then a constant; nothing is joined.
    """
    return df.withColumn(name, row.select(F.struct(*row.columns)).scalar())


def join_scores(base: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """Inner equi-joins of score tables to a base by row key.

    Chaining models over one DataFrame (``operators.ensemble``) needs no join at all; this
    form is for scores that exist as tables.
    """
    return reduce(lambda a, b: a.join(b, key, "inner"), parts, base)


def recover_rows(df: DataFrame, ids: DataFrame, key: str, keep_key: bool = False) -> DataFrame:
    """The rows whose key is in an id list (a semi join, so repeated ids do not repeat rows)."""
    out = df.join(ids.select(key), key, "left_semi")
    return out if keep_key else out.drop(key)


def lookup_default(
    df: DataFrame, table: DataFrame, key: str, value: str, default: float
) -> DataFrame:
    """Add ``value`` from a lookup table (unique keys), or the default where there is none.

    A plain left join: adaptive execution broadcasts the table if its measured size allows, and
    splits the partitions of hot keys if not.
    """
    right = table.select(key, as_column(value).alias("__value"))
    joined = df.join(right, key, "left")
    return joined.withColumn(value, F.coalesce("__value", F.lit(default))).drop("__value")
