"""Class weights as tables and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.parsing import as_column
from sluiceway.operators.joins import attach_row, lookup_default
from sluiceway.operators.stats import class_counts


def class_weights(df: DataFrame, key: str, name: str = "weight") -> DataFrame:
    """Per class: rows and ``total / (classes * rows)``."""
    counts = class_counts(df, [key])
    totals = counts.agg(F.sum("rows").cast("double").alias("total"), F.count("*").alias("classes"))
    weight = F.col("__t.total") / (F.col("__t.classes") * F.col("rows"))
    return attach_row(counts, totals, "__t").select(key, "rows", weight.alias(name))


def with_class_weights(
    df: DataFrame, key: str, counts_from: DataFrame | None = None, name: str = "weight"
) -> DataFrame:
    """Add the weight of each row's class; classes that were not counted get 1.0.

    ``counts_from`` is the table to count (the one before resampling, for instance).
    """
    table = class_weights(df if counts_from is None else counts_from, key, name)
    return lookup_default(df, table.select(key, name), key, name, 1.0)


def _label_counts(df: DataFrame, label: str) -> DataFrame:
    y = as_column(label)
    return df.agg(F.count_if(y == 0.0).alias("neg"), F.count_if(y == 1.0).alias("pos"))


def binary_weights(df: DataFrame, label: str) -> DataFrame:
    """One row: counts and balanced weights ``total / (2 * n)``; a missing class counts as 1."""
    n0 = F.when(F.col("neg") == 0, 1).otherwise(F.col("neg")).cast("double")
    n1 = F.when(F.col("pos") == 0, 1).otherwise(F.col("pos")).cast("double")
    return _label_counts(df, label).select(
        "neg", "pos",
        ((n0 + n1) / (n0 * 2.0)).alias("w0"), ((n0 + n1) / (n1 * 2.0)).alias("w1"),
    )


def with_binary_weights(
    df: DataFrame, label: str, counts_from: DataFrame | None = None, name: str = "weight"
) -> DataFrame:
    """Add the balanced weight of each row's label."""
    table = binary_weights(df if counts_from is None else counts_from, label)
    chosen = F.when(as_column(label) == 1.0, F.col("__w.w1")).otherwise(F.col("__w.w0"))
    return attach_row(df, table.select("w0", "w1"), "__w").withColumn(name, chosen).drop("__w")


def pos_weight(df: DataFrame, label: str) -> DataFrame:
    """One row: counts and ``neg / pos`` (1.0 without positives)."""
    ratio = F.when(F.col("pos") > 0, F.col("neg") / F.col("pos")).otherwise(1.0)
    return _label_counts(df, label).select("neg", "pos", ratio.alias("pos_weight"))


def pos_weights_without(df: DataFrame, label: str, key: str, groups: list[str]) -> dict[str, float]:
    """``neg / pos`` over all rows but a group's own, for every group, from one aggregate.

    1.0 without positives. Rows without a group count for all; a group without rows takes none away.
    """
    per = df.groupBy(as_column(key).alias("__group")).agg(
        F.count_if(as_column(label) == 0.0).alias("neg"),
        F.count_if(as_column(label) == 1.0).alias("pos"))
    sums = []
    for i, group in enumerate(groups):
        other = ~F.col("__group").eqNullSafe(F.lit(group))
        sums += [F.sum(F.when(other, F.col(c))).alias(f"{c}{i}") for c in ("neg", "pos")]
    row = per.agg(*sums).first()
    return {g: (row[f"neg{i}"] or 0) / row[f"pos{i}"] if row[f"pos{i}"] else 1.0
            for i, g in enumerate(groups)}


def with_pos_weight(
    df: DataFrame, label: str, counts_from: DataFrame | None = None, name: str = "weight"
) -> DataFrame:
    """Positives weigh ``neg / pos``, all other rows 1.0."""
    w = pos_weight(df if counts_from is None else counts_from, label).select("pos_weight")
    return df.withColumn(name, F.when(as_column(label) == 1.0, w.scalar()).otherwise(1.0))


def with_fixed_weight(
    df: DataFrame, label: str, positive: float = 10.0, negative: float = 1.0,
    name: str = "class_weight",
) -> DataFrame:
    """Constant weights by label."""
    return df.withColumn(
        name,
        F.when(as_column(label) == 1.0, F.lit(positive)).otherwise(F.lit(negative)),
    )
