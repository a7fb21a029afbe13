"""Polynomial logistic regression with a tuned decision threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sluiceway.functions.scores import class_probability, threshold_predict
from sluiceway.operators.evaluate import metrics_by, ranking_metrics
from sluiceway.operators.sampling import add_row_id, split_parts
from sluiceway.operators.tuning import grid_search_threshold
from sluiceway.operators.weights import pos_weight, with_pos_weight
from sluiceway.sources import persisted, save_model, small_table, write_table
from sluiceway.specs import TRAIN_VAL, Split


def train_logit_grid(
    train: DataFrame,
    test: DataFrame,
    out: str | None = None,
    split: Split = TRAIN_VAL,
    row_key: str | None = None,
    grid: list[tuple[int, float]] | None = None,
    **search_args,
) -> dict:
    """Split off validation rows, weigh, search the grid, score the untouched test table.

    Class weights come from the training part only. ``search_args`` go to the search
    (``select_by``, ``bins``, ``parallel``) and on to the estimator.
    """
    spark = train.sparkSession
    key = row_key or "row_id"
    parts = split_parts(train if row_key else add_row_id(train, key), key, split)
    fit_part, val_part = (parts[name] for name in list(split.parts)[:2])
    with persisted(with_pos_weight(fit_part, "label"), val_part) as (fit_rows, val_rows):
        weight = pos_weight(fit_rows, "label").first()["pos_weight"]
        found = grid_search_threshold(fit_rows, val_rows, grid, **search_args)
    extra = [c for c in ("attack_category",) if c in test.columns]
    scored = found.model.transform(test).select(
        "label", *extra, "probability", class_probability("probability").alias("lr_score")
    )
    predictions = scored.withColumn("lr_pred", threshold_predict("lr_score", found.threshold))
    winner = small_table(
        spark, [("lr_poly", found.threshold, found.f1, weight, found.k, found.reg)],
        "model string, best_threshold double, val_f1 double, pos_weight double, "
        "chisq_k int, reg_param double",
    )
    if out is not None:
        save_model(found.model, f"{out}/best_lr_poly")
        write_table(winner, f"{out}/thresholds")
        write_table(predictions, f"{out}/test_predictions")
        predictions = spark.read.parquet(f"{out}/test_predictions")
    return {
        "search": found, "winner": winner, "predictions": predictions,
        "metrics": metrics_by(predictions, "lr_pred", "label"),
        "ranking": lambda: ranking_metrics(predictions, "lr_score", "label"),
    }
