"""Soft vote of a multi-class forest, a multi-class logit and a binary boosted model."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.operators.ensemble import vote_predictions, vote_scores
from sluiceway.operators.evaluate import averaged_metrics, metrics_by
from sluiceway.operators.sampling import resample_to_target
from sluiceway.operators.stages import boosted, forest, indexer, logit
from sluiceway.operators.tuning import cv_tune
from sluiceway.operators.weights import with_binary_weights, with_class_weights
from sluiceway.sources import lineage_cut, persisted, save_model, small_table, write_table
from sluiceway.specs import NORMAL, RESAMPLE_CAP, RESAMPLE_CAP_SMALL, UNKNOWN, VOTE_WEIGHTS

_CATEGORY = "attack_category"
_CAPS = {"vote": RESAMPLE_CAP, "vote_small": RESAMPLE_CAP_SMALL}


def train_vote(
    train: DataFrame,
    test: DataFrame,
    out: str | None = None,
    preset: str = "vote",
    counts_from: str = "original",
    ratios: dict[str, float] | None = None,
    row_key: list[str] | None = None,
    resample_mode: str = "poisson",
    auto_tune: bool = False,
    tune_grid: dict[str, list] | None = None,
    weights: dict[str, float] | None = None,
    overrides: dict[str, dict] | None = None,
    spread: bool = False,
) -> dict:
    """Resample, weigh, fit three models, vote on the test table, evaluate.

    Both tables have ``label``, ``attack_category`` and ``features``. ``counts_from``
    chooses whether class weights correct for the table before or after resampling.
    Test rows pass through the models one after the other; nothing is joined.
    ``overrides`` maps ``rf`` / ``lr`` / ``gbt`` to estimator settings.
    """
    if counts_from not in ("original", "resampled"):
        raise ValueError("counts_from must be 'original' or 'resampled'")
    over = overrides or {}
    known = train.select(
        *[c for c in train.columns if c != "label"], F.col("label").cast("double").alias("label")
    ).filter(F.col(_CATEGORY) != UNKNOWN)
    drawn = resample_to_target(
        known, _CATEGORY, ratios, _CAPS[preset], row_key=row_key, mode=resample_mode
    )
    resampled = lineage_cut(drawn, spread=spread)
    counted = known if counts_from == "original" else resampled
    index_model = indexer(_CATEGORY, "category_label").fit(resampled)
    names = index_model.labelsArray[0]
    normal_index = names.index(NORMAL) if NORMAL in names else -1
    rows = with_class_weights(resampled, _CATEGORY, counted, "mcWeight")
    rows = with_binary_weights(rows, "label", counted, "binWeight")
    rows = index_model.transform(rows).select(
        "features", "label", "category_label", "mcWeight", "binWeight"
    )
    # Written by size: what the joins of the weights leave has a partition per shuffle partition, and each
    # of the fits' many passes would send a task result for every one of them to the driver.
    rows = lineage_cut(rows, spread=spread)
    started = time.monotonic()
    with persisted(rows) as ready:
        rf = forest(preset, "category_label", weight="mcWeight", **over.get("rf", {}))
        if auto_tune:
            rf_model = cv_tune(ready, rf, "category_label", tune_grid).bestModel
        else:
            rf_model = rf.fit(ready)
        lr_model = logit(preset, "category_label", weight="mcWeight", **over.get("lr", {})).fit(ready)
        gbt_model = boosted(preset, "label", weight="binWeight", **over.get("gbt", {})).fit(ready)
    seconds = time.monotonic() - started

    base = test.select(F.col("label").cast("double").alias("label"), _CATEGORY, "features")
    scores = vote_scores(base, rf_model, lr_model, gbt_model, normal_index)
    predictions = vote_predictions(scores, _CATEGORY, "label", weights)
    models = {"rf_multiclass": rf_model, "lr_multiclass": lr_model, "gbt_binary": gbt_model,
              "category_indexer": index_model}
    if out is not None:
        for name, model in models.items():
            save_model(model, f"{out}/{name}")
        w = VOTE_WEIGHTS if weights is None else weights
        total = sum(w.values())
        table = small_table(
            train.sparkSession, [tuple(w[k] / total for k in ("rf", "lr", "gbt"))],
            "w_rf double, w_lr double, w_gbt double",
        )
        write_table(table, f"{out}/ensemble_weights")
        write_table(predictions, f"{out}/test_predictions")
        predictions = train.sparkSession.read.parquet(f"{out}/test_predictions")
    else:
        predictions = lineage_cut(predictions)
    metrics = vote_metrics(predictions, seconds)
    if out is not None:
        write_table(metrics, f"{out}/metrics")
    return {"predictions": predictions, "metrics": metrics, "models": models,
            "cells": metrics_by(predictions, "binary_pred", "binary_label")}


def vote_metrics(predictions: DataFrame, train_seconds: float) -> DataFrame:
    """The six-column metrics table of a vote; both aggregates are one row each."""
    args = (predictions, "binary_pred", "binary_label")
    one = metrics_by(*args)
    weighted = averaged_metrics(*args).select("weighted_f1").scalar()
    return one.select(
        "accuracy", F.col("precision1").alias("precision"), F.col("recall1").alias("recall"),
        F.col("f11").alias("f1"), weighted.alias("weighted_f1"),
        F.lit(float(train_seconds)).alias("train_time_sec"),
    )
