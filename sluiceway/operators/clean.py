"""Typing, cleaning, null handling and de-duplication of whole tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.functions.labels import binary_label, category_map, clean_label
from sluiceway.functions.parsing import (
    as_column,
    as_double,
    coerce_double,
    is_finite,
    nonfinite_to_null,
    text_to_double,
)
from sluiceway.specs import (
    ATTACK_GROUPS,
    CONNECTION_NUMERIC,
    CSV_LABEL,
    LEAKAGE_COLUMNS,
)


def double_columns(df: DataFrame, except_: tuple[str, ...] = ()) -> list[str]:
    """Names of the double columns, in schema order."""
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.DoubleType) and f.name not in except_
    ]


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """One projection that swaps the given columns and keeps the others in place."""
    return df.select(*[
        new[c].alias(c) if c in new else as_column(c) for c in df.columns
    ])


def cast_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Cast the listed columns to double; failures become null."""
    return replace_columns(df, {c: as_double(c) for c in cols})


def cast_all(df: DataFrame, except_: tuple[str, ...] = (CSV_LABEL,)) -> DataFrame:
    """Every text column but the exceptions to double, thousands commas removed."""
    kinds = dict(df.dtypes)
    return replace_columns(df, {
        c: text_to_double(c) if kinds[c] == "string" else as_double(c)
        for c in df.columns if c not in except_
    })


def null_nonfinite(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """NaN and infinities to null in the given (or all) double columns."""
    return replace_columns(df, {c: nonfinite_to_null(c) for c in (cols or double_columns(df))})


def coerce_columns(df: DataFrame, cols: list[str], default: float = 0.0) -> DataFrame:
    """Those of the columns that exist to double, null and unparsable to the default."""
    return replace_columns(df, {c: coerce_double(c, default) for c in cols if c in df.columns})


def fill_missing(df: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Add absent columns with a constant; present columns stay as they are."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def leakage_matches(names: list[str], bases: list[str]) -> list[str]:
    """Names equal to a base name, or a ``__dup`` copy of one."""
    return [n for n in names if any(n == b or n.startswith(f"{b}__dup") for b in bases)]


def drop_columns(df: DataFrame, bases: list[str] | None = None) -> DataFrame:
    """Drop identifier columns and their duplicates."""
    return df.drop(*leakage_matches(df.columns, LEAKAGE_COLUMNS if bases is None else bases))


def rename_ci(df: DataFrame, name: str = CSV_LABEL) -> DataFrame:
    """Give the first column that matches without regard to case its canonical name."""
    hit = next((c for c in df.columns if c.lower() == name.lower()), name)
    return df if hit == name else df.withColumnRenamed(hit, name)


def filter_range(df: DataFrame, present: list[str], nonnegative: list[str]) -> DataFrame:
    """Rows where all columns are present and the listed ones are also >= 0."""
    return df.filter(in_range(present, nonnegative)) if present or nonnegative else df


def in_range(present: list[str], nonnegative: list[str]) -> Column:
    """The condition of ``filter_range``."""
    conditions = [as_column(c).isNotNull() for c in [*present, *nonnegative]]
    conditions += [as_column(c) >= 0 for c in nonnegative]
    return reduce(and_, conditions)


def filter_finite(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows whose listed columns that exist are all finite numbers."""
    conditions = [is_finite(c) for c in cols if c in df.columns]
    return df.filter(reduce(and_, conditions)) if conditions else df


def filter_labelled(df: DataFrame, label: str = CSV_LABEL) -> DataFrame:
    """Rows with a label."""
    return df.filter(as_column(label).isNotNull())


def dedup_rows(df: DataFrame) -> DataFrame:
    """Full-row de-duplication.

    A hash aggregate: each task keeps one copy before the shuffle, so a large group of
    copies arrives as one row per task.
    """
    return df.dropDuplicates()


def dedup_counted(df: DataFrame, name: str = "copies") -> DataFrame:
    """Full-row de-duplication that also tells how many copies each row had.

    Their sum is the number of input rows, so an audit needs no second scan.
    """
    return df.groupBy(*[as_column(c) for c in df.columns]).agg(F.count("*").alias(name))


def clean_connections(df: DataFrame) -> DataFrame:
    """Typed connection records: labels, numerics, row filter, nulls to 0.0.

    Adds ``label_raw``, ``label_binary`` and ``attack_category``.
    """
    return mark_connections(df, "__kept").filter("__kept").drop("__kept")


def mark_connections(df: DataFrame, name: str) -> DataFrame:
    """``clean_connections`` with all rows; those out of range have False in the column ``name``."""
    labelled = df.withColumns({"label_raw": clean_label("label")}).withColumns({
        "label_binary": binary_label("label_raw"),
        "attack_category": category_map("label_raw", ATTACK_GROUPS),
    })
    typed = cast_columns(labelled, CONNECTION_NUMERIC)
    marked = typed.withColumn(name, F.coalesce(in_range(["duration"], ["src_bytes", "dst_bytes"]), F.lit(False)))
    return marked.na.fill(0.0, CONNECTION_NUMERIC)


def clean_flow_stages(df: DataFrame, label: str = CSV_LABEL) -> dict[str, DataFrame]:
    """The cleaning steps of CSV flows by name, each built on the one before."""
    named = rename_ci(df, label)
    unique = dedup_rows(named)
    anonymous = drop_columns(unique)
    numeric = null_nonfinite(cast_all(anonymous, (label,)),
                             [c for c in anonymous.columns if c != label])
    return {
        "raw": named,
        "dedup": unique,
        "leakage_drop": anonymous,
        "cast": numeric,
        "label_filter": filter_labelled(numeric, label),
    }


def clean_flow_csv(df: DataFrame, label: str = CSV_LABEL) -> DataFrame:
    """CSV flows as text -> de-duplicated, identifier-free, numeric, labelled rows."""
    return clean_flow_stages(df, label)["label_filter"]
