"""Class profiles, one-pass column statistics and the steps fitted on them."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.parsing import as_column, nonfinite_to_null
from sluiceway.operators.clean import double_columns, replace_columns
from sluiceway.operators.joins import attach_row
from sluiceway.specs import CSV_LABEL, CSV_TARGET

LABELS = (CSV_LABEL, CSV_TARGET)


# -- classes ----------------------------------------------------------------

def class_counts(df: DataFrame, keys: list[str], name: str = "rows") -> DataFrame:
    """Rows per key combination."""
    return df.groupBy(*[as_column(k) for k in keys]).agg(F.count("*").alias(name))


def class_profile(df: DataFrame, key: str) -> DataFrame:
    """Per class: rows, share; and on each row the total, number of classes, largest class.

    The totals are one scalar subquery over the class counts. Spark computes the counts once
    (the exchange is reused) and no window pulls all classes into one task.
    """
    counts = class_counts(df, [key])
    totals = counts.agg(
        F.sum("rows").alias("total"), F.count("*").alias("classes"), F.max("rows").alias("largest")
    )
    share = F.col("rows") / F.col("__t.total")
    return attach_row(counts, totals, "__t").select(key, "rows", share.alias("share"), "__t.*")


def top_classes(df: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """Classes by falling count; with ``n`` only the first ones (ties by key)."""
    ordered = class_counts(df, keys).orderBy(F.desc("rows"), *keys)
    return ordered if n is None else ordered.limit(n)


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """(position, stage, rows) of every named stage, for an audit table.

    Each stage is counted by its own scan. The jobs take their counts from a table that they write
    anyway, in which left-out rows are marked or counted. (Spark's observations would count in
    passing, too, but a session that has used one can no longer serialise models with a training
    summary, in Spark 4.1.)
    """
    out = None
    for i, (name, df) in enumerate(stages.items()):
        row = df.agg(F.count("*").alias("rows")).select(
            F.lit(i).alias("position"), F.lit(name).alias("stage"), "rows"
        )
        out = row if out is None else out.union(row)
    return out


# -- column statistics ------------------------------------------------------

def mean_stats(c: Column) -> dict[str, Column]:
    return {"mean": F.avg(c)}


def variance_stats(c: Column) -> dict[str, Column]:
    return {"variance": F.var_samp(c)}


def median_stats(accuracy: int = 10_000) -> Callable[[Column], dict[str, Column]]:
    return lambda c: {"median": F.percentile_approx(c, 0.5, accuracy)}


def skew_stats(accuracy: int = 5_000) -> Callable[[Column], dict[str, Column]]:
    return lambda c: {
        "mean": F.avg(c), "std": F.stddev_pop(c), "median": F.percentile_approx(c, 0.5, accuracy),
    }


def column_stats(
    df: DataFrame, cols: list[str], make: Callable[[Column], dict[str, Column]]
) -> DataFrame:
    """One row per column with the statistics of ``make``; one aggregate over the table."""
    made = {c: make(as_column(c)) for c in cols}
    wide = df.agg(*[
        F.struct(*[e.cast("double").alias(s) for s, e in stats.items()]).alias(f"s{i}")
        for i, stats in enumerate(made.values())
    ])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("stats"))
        for i, c in enumerate(cols)
    ])
    return wide.select(F.explode(rows).alias("r")).select("r.column", "r.stats.*")


def _by_column(stats: DataFrame) -> dict[str, dict[str, float | None]]:
    """The statistics rows (one per column of the table) as a dict."""
    return {
        r["column"]: {k: r[k] for k in stats.columns if k != "column"} for r in stats.collect()
    }


def _zero_if_undefined(v: float | None) -> float:
    return 0.0 if v is None or math.isnan(v) else v


@dataclass(frozen=True)
class _Range:
    """Open value range (None: unbounded) with the rows below it and inside it."""

    low: float | None
    high: float | None
    below: int
    inside: int

    def holds(self, v: Column) -> Column:
        cond = v.isNotNull()
        if self.low is not None:
            cond = cond & (v > self.low)
        if self.high is not None:
            cond = cond & (v < self.high)
        return cond


def exact_medians(
    df: DataFrame, cols: list[str], accuracy: int = 10_000
) -> dict[str, float | None]:
    """Exact lower median of each column, without sorting and without large states.

    Two aggregates over the table per round serve all open columns at once: an approximate
    quantile pair around the median narrows the value range of a column by a factor of
    about ``accuracy / 6``, and counts at both edges keep the rank exact, so the result does
    not depend on the quality of the approximation. Both edges are values of the column, so every
    round leaves fewer of them, until the rank falls on an edge. NaN and infinities count as missing.
    """
    if not cols:
        return {}
    value = {c: nonfinite_to_null(c) for c in cols}
    first = df.agg(*[F.count(value[c]).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    rows = {c: first[f"n{i}"] for i, c in enumerate(cols)}
    rank = {c: (rows[c] + 1) // 2 for c in cols}
    done: dict[str, float | None] = {c: None for c in cols if rows[c] == 0}
    spans = {c: _Range(None, None, 0, rows[c]) for c in cols if c not in done}
    pad = 2.0 / accuracy

    while spans:
        inner = df.select(*[
            F.when(r.holds(value[c]), value[c]).alias(f"v{i}")
            for i, (c, r) in enumerate(spans.items())
        ])
        exprs = []
        for i, (c, r) in enumerate(spans.items()):
            p = (rank[c] - r.below - 0.5) / r.inside
            edges = [max(p - pad, 0.0), min(p + pad, 1.0)]
            exprs.append(F.percentile_approx(f"v{i}", edges, accuracy))
        found = inner.agg(*[e.alias(f"q{i}") for i, e in enumerate(exprs)]).first()
        edges_of = {c: found[f"q{i}"] for i, c in enumerate(spans)}
        counts = df.agg(*[
            F.count_if(cond).alias(f"{kind}{i}")
            for i, (c, (low, high)) in enumerate(edges_of.items())
            for kind, cond in (
                ("lt_low", value[c] < low), ("le_low", value[c] <= low),
                ("lt_high", value[c] < high), ("le_high", value[c] <= high),
            )
        ]).first()
        narrowed = {}
        for i, (c, (low, high)) in enumerate(edges_of.items()):
            r, k = spans[c], rank[c]
            lt_low, le_low, lt_high, le_high = (
                counts[f"{kind}{i}"] for kind in ("lt_low", "le_low", "lt_high", "le_high")
            )
            if lt_low < k <= le_low:
                done[c] = low
            elif lt_high < k <= le_high:
                done[c] = high
            elif k <= lt_low:
                narrowed[c] = _Range(r.low, low, r.below, lt_low - r.below)
            elif k <= lt_high:
                narrowed[c] = _Range(low, high, le_low, lt_high - le_low)
            else:
                narrowed[c] = _Range(high, r.high, le_high, r.below + r.inside - le_high)
        spans = narrowed
    return {c: done[c] for c in cols}


# -- fitted steps -----------------------------------------------------------

def fit_impute(
    df: DataFrame, how: str = "median", exact: bool = False, accuracy: int = 10_000,
    except_: tuple[str, ...] = LABELS,
) -> dict[str, float]:
    """Fill value of every non-label double column; undefined statistics give 0.0."""
    if how not in ("median", "mean"):
        raise ValueError("how must be 'median' or 'mean'")
    cols = double_columns(df, except_)
    if not cols:
        return {}
    if how == "median" and exact:
        values = exact_medians(df, cols, accuracy)
    else:
        stats = _by_column(
            column_stats(df, cols, mean_stats if how == "mean" else median_stats(accuracy))
        )
        values = {c: stats[c][how] for c in cols}
    return {c: _zero_if_undefined(values[c]) for c in cols}


def impute(df: DataFrame, how: str = "median", **kw) -> tuple[DataFrame, dict[str, float]]:
    """Fill nulls (and NaN) of the non-label double columns; returns the fill values too."""
    fitted = fit_impute(df, how, **kw)
    return (df.na.fill(fitted) if fitted else df), fitted


def skew_proxy(stats: DataFrame) -> DataFrame:
    """|mean - median| / std per column; 0.0 where std is zero or undefined."""
    usable = (F.col("std") != 0.0) & ~F.isnan("std")
    ratio = F.abs((F.col("mean") - F.col("median")) / F.col("std"))
    return stats.withColumn("skew", F.when(usable, F.coalesce(ratio, F.lit(0.0))).otherwise(0.0))


def skew_table(
    df: DataFrame, cols: list[str], accuracy: int = 5_000, exact: bool = False
) -> DataFrame:
    """(column, mean, std, median, skew), with approximate or exact medians."""
    if not exact:
        return skew_proxy(column_stats(df, cols, skew_stats(accuracy)))
    medians = exact_medians(df, cols)
    moments = column_stats(df, cols, lambda c: {"mean": F.avg(c), "std": F.stddev_pop(c)})
    pairs = [x for c, m in medians.items() for x in (F.lit(c), F.lit(m).cast("double"))]
    return skew_proxy(
        moments.withColumn("median", F.element_at(F.create_map(*pairs), F.col("column")))
    )


def fit_log_skewed(
    df: DataFrame, threshold: float, accuracy: int = 5_000, exact: bool = False,
    except_: tuple[str, ...] = LABELS,
) -> list[str]:
    """Columns whose skew proxy exceeds the threshold (the proxy never exceeds 1)."""
    cols = double_columns(df, except_)
    if not cols:
        return []
    stats = _by_column(skew_table(df, cols, accuracy, exact))
    return [c for c in cols if stats[c]["skew"] > threshold]


def log_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """log1p of max(x, 0) in the listed columns."""
    return replace_columns(df, {
        c: F.log1p(F.when(as_column(c) < 0.0, 0.0).otherwise(as_column(c))) for c in cols
    })


def log_skewed(df: DataFrame, threshold: float, **kw) -> tuple[DataFrame, list[str]]:
    """Log-scale the skewed columns; returns their names too."""
    cols = fit_log_skewed(df, threshold, **kw)
    return log_columns(df, cols), cols


def fit_low_variance(
    df: DataFrame, threshold: float = 1e-4, except_: tuple[str, ...] = LABELS
) -> list[str]:
    """Columns whose sample variance is undefined or below the threshold."""
    cols = double_columns(df, except_)
    if not cols:
        return []
    stats = _by_column(column_stats(df, cols, variance_stats))
    return [c for c in cols if _zero_if_undefined(stats[c]["variance"]) < threshold]


def drop_low_variance(
    df: DataFrame, threshold: float = 1e-4, **kw
) -> tuple[DataFrame, list[str]]:
    """Drop near-constant columns; returns their names too."""
    cols = fit_low_variance(df, threshold, **kw)
    return df.drop(*cols), cols
