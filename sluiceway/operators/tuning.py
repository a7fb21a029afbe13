"""Model search: driver loops over distributed fits."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.errors import IllegalArgumentException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.hashing import hash_bucket, uniform
from sluiceway.functions.scores import class_probability
from sluiceway.operators.evaluate import best_threshold
from sluiceway.operators.sampling import sample_fraction
from sluiceway.operators.selection import rank_features
from sluiceway.operators.stages import ranked_logit
from sluiceway.sources.sinks import small_table
from sluiceway.sources.workspace import persisted
from sluiceway.specs import CV_GRID, LOGIT_GRID

_SEARCH_SCHEMA = (
    "chisq_k int, reg_param double, status string, best_threshold double, val_f1 double, "
    "precision double, recall double, fit_seconds double"
)


@dataclass(frozen=True)
class Search:
    """Outcome of a grid search: best model, its settings, and a row per configuration."""

    model: PipelineModel
    k: int
    reg: float
    threshold: float
    f1: float
    trials: DataFrame


def grid_search_threshold(
    train: DataFrame,
    val: DataFrame,
    grid: list[tuple[int, float]] | None = None,
    label: str = "label",
    weight: str | None = "weight",
    select_by: str = "f",
    bins: int = 10,
    parallel: int = 4,
    **override,
) -> Search:
    """Fit every (k, reg) on train, tune the F1 threshold on validation, keep the strict best.

    Features are ranked once (``select_by``: ``f`` or ``chi2``) and every configuration takes its
    slice. Configurations that come to the same slice and strength, as those with k beyond the width
    do, are fitted once. Fits don't depend on each other: ``parallel`` of them run at a time, each in
    a scheduler pool of its own. A configuration that Spark rejects as an illegal argument is recorded
    with its error and skipped; any other failure ends the search. Validation rows of both labels are
    required. Scores stay in Spark: one row per configuration reaches the driver. Persist both tables
    first.
    """
    labels = val.agg(F.count_if(F.col(label) == 1.0), F.count_if(F.col(label) == 0.0)).first()
    if not all(labels):
        raise ValueError(f"validation needs rows of both labels, it has (1, 0): {tuple(labels)}")
    grid = LOGIT_GRID if grid is None else grid
    spark = train.sparkSession
    ranking = rank_features(train, label=label, test=select_by, bins=bins)

    def key(k: int, reg: float) -> tuple:
        return min(k, len(ranking.order)), reg

    def fit(pool: int, k: int, reg: float):
        started = time.monotonic()
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"grid-{pool}")
        try:
            model = ranked_logit(ranking, k, reg, label, weight, **override).fit(train)
        except (IllegalArgumentException, ValueError) as e:
            return str(e).splitlines()[0][:200], None
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
        return model, time.monotonic() - started

    distinct = list(dict.fromkeys(key(k, reg) for k, reg in grid))
    with ThreadPoolExecutor(max(1, parallel)) as threads:
        run = inheritable_thread_target(spark)(fit)
        fits = [threads.submit(run, i, *c) for i, c in enumerate(distinct)]
        fitted = {c: f.result() for c, f in zip(distinct, fits, strict=True)}
    models = {c: model for c, (model, seconds) in fitted.items() if seconds is not None}
    tuned = {c: row for c, row in zip(models, _tuned(val, list(models.values()), label), strict=True)}

    best, trials = None, []
    for k, reg in grid:
        model, seconds = fitted[key(k, reg)]
        if seconds is None:
            trials.append((k, reg, f"failed: {model}", None, None, None, None, None))
            continue
        th = tuned[key(k, reg)]
        trials.append((k, reg, "ok", th["threshold"], th["f1"], th["precision"], th["recall"],
                       seconds))
        if best is None or th["f1"] > best[0]:
            best = (th["f1"], th["threshold"], k, reg, model)
    table = small_table(spark, trials, _SEARCH_SCHEMA)
    if best is None:
        raise RuntimeError(f"no configuration could be fitted: {[t[2] for t in trials]}")
    f1, threshold, k, reg, model = best
    return Search(model, k, reg, threshold, f1, table)


def _tuned(val: DataFrame, models: list[PipelineModel], label: str) -> list:
    """The best threshold of every model, from one scan: the models are chained over the rows."""
    if not models:
        return []
    out = val
    for i, model in enumerate(models):
        made = ("sel_features", "poly_features", "rawPrediction", "probability", "prediction")
        out = model.transform(out).withColumn(f"__score{i}", class_probability("probability")).drop(*made)
    each = F.explode(F.array(*[
        F.struct(F.lit(i).alias("model"), F.col(f"__score{i}").alias("score")) for i in range(len(models))
    ])).alias("of")
    scored = out.select(label, each).select(label, "of.*")
    best = {r["model"]: r for r in best_threshold(scored, "score", label, keys=["model"]).collect()}
    return [best[i] for i in range(len(models))]


def cv_tune(
    df: DataFrame,
    estimator: RandomForestClassifier,
    label: str,
    grid: dict[str, list] | None = None,
    folds: int = 2,
    fraction: float = 0.30,
    seed: int = 42,
    row_key: list[str] | None = None,
):
    """Best model of a small cross-validated grid on a sample, by F1.

    With ``row_key`` the sample and the folds are hashes of the key, and rows are laid out by it, so
    that the averages are the same for any partitioning of the input; rows with equal keys, such as
    copies made by resampling, share a fold. Without, both are drawn at random.
    """
    builder = ParamGridBuilder()
    for name, values in (CV_GRID if grid is None else grid).items():
        builder = builder.addGrid(estimator.getParam(name), values)
    cv = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=builder.build(),
        evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName="f1"),
        numFolds=folds,
        seed=seed,
    )
    if row_key is None:
        rows = sample_fraction(df, fraction, seed)
    else:
        rows = cv_folds(df, row_key, folds, fraction, seed)
        cv = cv.setFoldCol("fold")
        # Bootstrap draws of trees depend on a row's partition and place in it.
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(parts, *row_key).sortWithinPartitions(*row_key)
    with persisted(rows) as tune:
        return cv.fit(tune)


def cv_folds(df: DataFrame, row_key: list[str], folds: int = 2, fraction: float = 0.30,
             seed: int = 42) -> DataFrame:
    """A sample by key hash with its ``fold`` (0 ... folds - 1) by another; both have their own salt."""
    if not 0.0 < fraction <= 1.0:
        raise ValueError(f"fraction must be in (0, 1], got {fraction}")
    kept = df.filter(uniform(*row_key, seed=seed, portable=True) < fraction)
    fold = hash_bucket(*row_key, buckets=folds, salt=f"#cv{seed}").cast("int")
    return kept.withColumn("fold", fold)
