"""CSV flows: many drifting files to scaled vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.functions.parsing import as_column
from sluiceway.operators.clean import (
    cast_all,
    dedup_counted,
    drop_columns,
    filter_labelled,
    null_nonfinite,
    rename_ci,
)
from sluiceway.operators.features import csv_flow_features
from sluiceway.operators.sampling import sample_fraction, split_by_row
from sluiceway.operators.stages import csv_flow_stages
from sluiceway.operators.stats import (
    fit_impute,
    fit_log_skewed,
    fit_low_variance,
    log_columns,
    top_classes,
)
from sluiceway.sources import lineage_cut, read_csv_union, save_model, write_parts
from sluiceway.specs import CSV_LABEL, CSV_TARGET, THREE_WAY, Split

_COPIES, _BAD, _SPLIT = "__copies", "__malformed", "split"


def prepare_csv_flows(
    spark: SparkSession,
    glob: str,
    out: str,
    impute: str = "median",
    exact_median: bool = False,
    fraction: float = 1.0,
    log_threshold: float | None = None,
    variance_threshold: float = 1e-4,
    split: Split = THREE_WAY,
    fit_on: str = "train",
    files: int | None = None,
    spread: bool = False,
    save_stages: bool = True,
) -> dict:
    """Union, clean, derive, impute, prune, assemble and scale; one table partitioned by split.

    ``fit_on="train"`` takes every fitted statistic (fill values, skew, variance, scaling)
    from the training part; ``"all"`` takes them from all rows. Rows fall into parts by a
    hash of their content, after de-duplication, so a rerun gives the same parts.

    The cleaned rows are written once to the shared folder: the de-duplication shuffle is
    not repeated by the passes that follow, and a lost executor costs no rerun of it. The
    counts of the audit come from that table: lines and raw rows as sums of copies, and lines with a
    wrong number of fields as the copies of one marked row, so that the files are parsed once and a
    repeated task counts nothing twice.
    """
    if fit_on not in ("train", "all"):
        raise ValueError("fit_on must be 'train' or 'all'")
    lines = sample_fraction(read_csv_union(spark, glob, malformed=_BAD), fraction)
    raw = rename_ci(lines.withColumn(_BAD, F.col(_BAD).isNotNull()))
    unique = drop_columns(dedup_counted(raw, _COPIES))
    own = (CSV_LABEL, _COPIES, _BAD)
    numeric = null_nonfinite(cast_all(unique, own), [c for c in unique.columns if c not in own])
    tagged = split_by_row(numeric, split, _SPLIT, skip=(_COPIES, _BAD))
    cleaned = lineage_cut(tagged, spread=spread)
    good = ~F.col(_BAD)
    audit = cleaned.agg(
        F.coalesce(F.sum(_COPIES), F.lit(0)).alias("lines"),
        F.coalesce(F.sum(F.when(F.col(_BAD), F.col(_COPIES))), F.lit(0)).alias("malformed_lines"),
        F.coalesce(F.sum(F.when(good, F.col(_COPIES))), F.lit(0)).alias("raw_rows"),
        F.count_if(good).alias("dedup_rows"),
        F.count_if(good & as_column(CSV_LABEL).isNotNull()).alias("labelled_rows"),
    )

    # The part travels as text, so it is never a feature.
    df = csv_flow_features(filter_labelled(cleaned.filter(good).drop(_COPIES, _BAD)))

    def fit_rows(d: DataFrame) -> DataFrame:
        return d if fit_on == "all" else d.filter(F.col(_SPLIT) == next(iter(split.parts)))

    fills = fit_impute(fit_rows(df), impute, exact=exact_median)
    df = df.na.fill(fills) if fills else df
    logged: list[str] = []
    if log_threshold is not None:
        logged = fit_log_skewed(fit_rows(df), log_threshold)
        df = log_columns(df, logged)
    dropped = fit_low_variance(fit_rows(df), variance_threshold)
    df = df.drop(*dropped)
    model = csv_flow_stages(df).fit(fit_rows(df))
    vectors = model.transform(df).select("features", CSV_TARGET, CSV_LABEL, _SPLIT)
    write_parts(vectors, f"{out}/flows", _SPLIT, split.parts, files)
    if save_stages:
        save_model(model, f"{out}/stages")
    flows = spark.read.parquet(f"{out}/flows")
    return {
        "flows": flows, "audit": audit, "filled": fills, "logged": logged, "dropped": dropped,
        "distribution": top_classes(flows, [CSV_LABEL, CSV_TARGET]), "stages": model,
    }
