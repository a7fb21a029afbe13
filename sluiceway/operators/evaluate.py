"""Evaluation as DataFrame aggregation: confusion, per-class metrics, ROC / PR, thresholds."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.parsing import as_column
from sluiceway.operators.joins import attach_row
from sluiceway.sources.sinks import stamp
from sluiceway.sources.workspace import lineage_cut

BINARY = (0.0, 1.0)


def _ratio(n: Column, d: Column) -> Column:
    """n / d as double, 0.0 where the denominator is zero."""
    return F.when(d > 0, n.cast("double") / d).otherwise(0.0)


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(0.0)


def _cell(i: int, j: int) -> str:
    return f"cm{i}_{j}"


def _sum(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def confusion_cells(
    df: DataFrame, pred: str, label: str, classes: Sequence[float] = BINARY, keys: Sequence[str] = ()
) -> DataFrame:
    """One row per key combination: rows, correct and a column per (true, predicted) cell.

    The class list is fixed, so classes that never occur have zero cells. One aggregate
    with counters only: each task sends one row per key combination.
    """
    y, p = as_column(label).cast("double"), as_column(pred).cast("double")
    known = df.filter(y.isNotNull() & ~F.isnan(y) & p.isNotNull() & ~F.isnan(p))
    counters = [
        F.count_if((y == float(t)) & (p == float(q))).alias(_cell(i, j))
        for i, t in enumerate(classes) for j, q in enumerate(classes)
    ]
    return known.groupBy(*[as_column(k) for k in keys]).agg(
        F.count("*").alias("rows"), F.count_if(y == p).alias("correct"), *counters
    )


def confusion_matrix(
    df: DataFrame, pred: str, label: str, classes: Sequence[float] = BINARY, keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, label, prediction, rows) with a row for every pair of the class list."""
    cells = confusion_cells(df, pred, label, classes, keys)
    entries = F.array(*[
        F.struct(F.lit(float(t)).alias("label"), F.lit(float(q)).alias("prediction"),
                 F.col(_cell(i, j)).alias("rows"))
        for i, t in enumerate(classes) for j, q in enumerate(classes)
    ])
    return cells.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*")


def _per_class(n: int) -> list[dict[str, Column]]:
    """Support, precision, recall and F1 of each class as expressions over the cells."""
    out = []
    for i in range(n):
        hit = F.col(_cell(i, i))
        true = _sum([F.col(_cell(i, j)) for j in range(n)])
        guessed = _sum([F.col(_cell(j, i)) for j in range(n)])
        precision, recall = _ratio(hit, guessed), _ratio(hit, true)
        out.append({"support": true, "precision": precision, "recall": recall,
                    "f1": _f1(precision, recall)})
    return out


def class_metrics(
    df: DataFrame, pred: str, label: str, classes: Sequence[float] = BINARY, keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, class, support, precision, recall, f1); undefined ratios are 0.0."""
    cells = confusion_cells(df, pred, label, classes, keys)
    entries = F.array(*[
        F.struct(F.lit(float(c)).alias("class"), *[e.alias(k) for k, e in m.items()])
        for c, m in zip(classes, _per_class(len(classes)), strict=True)
    ])
    return cells.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*")


def averaged_metrics(
    df: DataFrame, pred: str, label: str, classes: Sequence[float] = BINARY, keys: Sequence[str] = ()
) -> DataFrame:
    """Accuracy with macro (per class) and weighted (per true row) precision, recall, F1."""
    cells = confusion_cells(df, pred, label, classes, keys)
    per_class = _per_class(len(classes))
    total = _sum([m["support"] for m in per_class])
    macro = [
        (_sum([m[k] for m in per_class]) / F.lit(float(len(classes)))).alias(f"macro_{k}")
        for k in ("precision", "recall", "f1")
    ]
    weighted = [
        _ratio(_sum([m[k] * m["support"] for m in per_class]), total).alias(f"weighted_{k}")
        for k in ("precision", "recall", "f1")
    ]
    return cells.select(
        *keys, "rows", _ratio(F.col("correct"), F.col("rows")).alias("accuracy"), *macro, *weighted
    )


def _binary_row(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    zero, one = _per_class(2)
    named = [
        (_ratio(F.col("correct"), F.col("rows")), "accuracy"),
        (zero["precision"], "precision0"), (zero["recall"], "recall0"), (zero["f1"], "f10"),
        (one["precision"], "precision1"), (one["recall"], "recall1"), (one["f1"], "f11"),
        ((zero["f1"] + one["f1"]) / F.lit(2.0), "macroF1"),
    ]
    matrix = [F.col(_cell(i, j)).cast("double").alias(f"cm{i}{j}") for i in (0, 1) for j in (0, 1)]
    return cells.select(*keys, "rows", *[c.alias(n) for c, n in named], *matrix)


def metrics_by(
    df: DataFrame, pred: str, label: str, keys: Sequence[str] = (), total_over: str | None = None,
    total_name: str = "ALL",
) -> DataFrame:
    """Binary metrics per key combination from one aggregate.

    Without keys an empty input gives one row of zeros. ``total_over`` adds a row per
    combination of the other keys in which that key is ``total_name``; it is summed from
    the cells, each counted for its own key and for the total, so the rows are read once.
    """
    cells = confusion_cells(df, pred, label, BINARY, keys)
    if total_over is not None:
        counters = [c for c in cells.columns if c not in keys]
        both = F.explode(F.array(F.col(total_over).cast("string"), F.lit(total_name)))
        cells = cells.withColumn(total_over, both).groupBy(*keys).agg(
            *[F.sum(c).alias(c) for c in counters])
    return _binary_row(cells, keys)


def metrics_row(
    df: DataFrame, pred: str, label: str, run_id: str, holdout: str, split: str, src_ds: str
) -> DataFrame:
    """The metrics record of one slice, stamped with the save time."""
    row = metrics_by(df, pred, label)
    tags = {"run_id": run_id, "holdout": holdout, "split": split, "src_ds": src_ds}
    return stamp(row.select(*[F.lit(v).alias(k) for k, v in tags.items()], "*"))


# -- ranking metrics --------------------------------------------------------

def score_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, pos, neg) per distinct score. NaN and null scores are left out."""
    x, y = as_column(score).cast("double"), as_column(label).cast("double")
    return (
        df.select(x.alias("score"), y.alias("y"))
        .filter(F.col("score").isNotNull() & ~F.isnan("score"))
        .groupBy("score")
        .agg(F.count_if(F.col("y") == 1.0).alias("pos"), F.count_if(F.col("y") == 0.0).alias("neg"))
    )


def running_counts(per_score: DataFrame, buckets: int = 512) -> DataFrame:
    """To ``score_counts``: both counts over all lower scores.

    Approximate quantiles of the distinct scores cut them into at most ``buckets`` ranges of
    similar size, each range is summed on its own, and the totals of the (few) ranges before
    it are added. The result is exact for any cut points, and no task orders more than one range.
    """
    before = "rows between unbounded preceding and 1 preceding"

    def running(c: str, over: str) -> Column:
        return F.expr(f"coalesce(sum({c}) over ({over} {before}), 0)")

    quantiles = [i / buckets for i in range(1, buckets)]
    found = per_score.agg(F.percentile_approx("score", quantiles, 20 * buckets)).first()[0]
    cuts = sorted({c for c in found or [] if math.isfinite(c)})
    ranges = Bucketizer(
        splits=[float("-inf"), *cuts, float("inf")], inputCol="score", outputCol="range"
    ).transform(per_score)
    within = ranges.select("*", *[
        running(c, "partition by range order by score").alias(f"{c}_in") for c in ("pos", "neg")
    ])
    # At most `buckets` rows, as there are no more ranges.
    offsets = ranges.groupBy("range").agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("n")
    ).select("range", running("p", "order by range").alias("pos_off"),
             running("n", "order by range").alias("neg_off"))
    return within.join(F.broadcast(offsets), "range").select(
        "score", "pos", "neg",
        (F.col("pos_in") + F.col("pos_off")).alias("pos_below"),
        (F.col("neg_in") + F.col("neg_off")).alias("neg_below"),
    )


def ranking_metrics(df: DataFrame, score: str, label: str, **kw) -> DataFrame:
    """One row: positives, negatives, exact ROC-AUC and PR-AUC (trapezoids, ties as one point).

    The areas are 0.0 without positives, and so is ROC-AUC without negatives. The table is
    read once; the counts per score are written to the shared folder for the two steps
    that follow.
    """
    per_score = lineage_cut(score_counts(df, score, label))
    totals = per_score.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = attach_row(running_counts(per_score, **kw), totals, "all")
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    # Predicting every score from here upwards as positive gives (tp, fp); without the
    # score itself (tp0, fp0). At the top there is nothing above: precision continues level.
    tp, fp = F.col("all.pos") - F.col("pos_below"), F.col("all.neg") - F.col("neg_below")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    here = tp / (tp + fp)
    above = F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(here)
    area = counts.filter(F.col("pos") + F.col("neg") > 0).agg(
        F.sum(pos * (F.col("neg_below") + neg / 2.0)).alias("wins"),
        F.sum(pos * (here + above) / 2.0).alias("pr"),
        F.coalesce(F.sum("pos"), F.lit(0)).alias("positives"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("negatives"),
    )
    p, n = F.col("positives").cast("double"), F.col("negatives").cast("double")
    return area.select(
        "positives", "negatives",
        F.when((p > 0) & (n > 0), F.col("wins") / (p * n)).otherwise(0.0).alias("roc_auc"),
        F.when(p > 0, F.col("pr") / p).otherwise(0.0).alias("pr_auc"),
    )


# -- thresholds -------------------------------------------------------------

def score_bin(score: Column | str, steps: int = 100) -> Column:
    """Largest i in 0 … steps with score >= i / steps; null, NaN and negatives are 0.

    ``floor`` alone errs where i / steps is not exact in binary, so both neighbours are
    compared with the very numbers that serve as thresholds.
    """
    s = F.coalesce(F.nanvl(as_column(score).cast("double"), F.lit(0.0)), F.lit(0.0))
    s = F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))
    b = F.floor(s * F.lit(float(steps)))
    return (
        F.when(s >= (b + 1) / F.lit(float(steps)), b + 1)
        .when(s < b / F.lit(float(steps)), b - 1)
        .otherwise(b)
        .cast("int")
    )


def threshold_sweep(
    df: DataFrame, score: str, label: str, keys: Sequence[str] = (), steps: int = 100
) -> DataFrame:
    """Precision, recall and F1 at thresholds 1/steps … (steps-1)/steps, per key combination.

    Rows collapse to at most ``steps + 1`` bins per key combination before anything is
    brought together; every threshold is reported, also where no score falls.
    """
    y = as_column(label).cast("double")
    bins = (
        df.select(*keys, score_bin(score, steps).alias("bin"), y.alias("y"))
        .groupBy(*keys, "bin")
        .agg(F.count_if(F.col("y") == 1.0).alias("pos"), F.count_if(F.col("y") == 0.0).alias("neg"))
    )
    packed = bins.groupBy(*keys).agg(F.collect_list(F.struct("bin", "pos", "neg")).alias("bins"))

    def total(field: str, least: Column) -> Column:
        return F.aggregate(
            "bins", F.lit(0).cast("bigint"),
            lambda acc, b: acc + F.when(b["bin"] >= least, b[field]).otherwise(F.lit(0)),
        )

    grid = packed.select(
        *keys, "bins", F.explode(F.sequence(F.lit(1), F.lit(steps - 1))).alias("step")
    )
    counted = grid.select(
        *keys, "step", total("pos", F.col("step")).alias("tp"),
        total("neg", F.col("step")).alias("fp"), total("pos", F.lit(0)).alias("positives"),
    )
    precision = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = _ratio(F.col("tp"), F.col("positives"))
    return counted.select(
        *keys, (F.col("step") / F.lit(float(steps))).alias("threshold"),
        "tp", "fp", (F.col("positives") - F.col("tp")).alias("fn"),
        precision.alias("precision"), recall.alias("recall"), _f1(precision, recall).alias("f1"),
    )


def best_threshold(
    df: DataFrame, score: str, label: str, keys: Sequence[str] = (), steps: int = 100
) -> DataFrame:
    """The threshold of the largest F1 per key combination; the lowest one wins ties."""
    sweep = threshold_sweep(df, score, label, keys, steps)
    fields = ["threshold", "f1", "precision", "recall"]
    best = F.max_by(F.struct(*fields), F.struct("f1", -F.col("threshold")))
    return sweep.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.*")
