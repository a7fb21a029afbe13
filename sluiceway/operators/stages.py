"""Feature stages and estimators of pyspark.ml, set up from specs."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import (
    OneHotEncoder,
    PolynomialExpansion,
    StandardScaler,
    StringIndexer,
    UnivariateFeatureSelector,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.operators.clean import double_columns
from sluiceway.operators.selection import Ranking
from sluiceway.specs import (
    CONNECTION_CATEGORICAL,
    CONNECTION_NUMERIC,
    CSV_TARGET,
    FLOW_CATEGORICAL,
    FOREST_PRESETS,
    GBT_PRESETS,
    LOGIT_PRESETS,
)


def indexer(column: str, out: str | None = None) -> StringIndexer:
    """Text to index by falling frequency; unseen text gets one more index."""
    return StringIndexer(inputCol=column, outputCol=out or f"{column}_idx", handleInvalid="keep")


def indexers(columns: list[str]) -> StringIndexer:
    """One stage for several columns: a single pass counts them all."""
    return StringIndexer(
        inputCols=columns, outputCols=[f"{c}_idx" for c in columns], handleInvalid="keep"
    )


def assembler(cols: list[str], out: str = "features", invalid: str = "error") -> VectorAssembler:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid=invalid)


def scaler(source: str = "features_raw", out: str = "features") -> StandardScaler:
    """Unit standard deviation without centring, which keeps vectors sparse."""
    return StandardScaler(inputCol=source, outputCol=out, withMean=False, withStd=True)


def connection_stages() -> Pipeline:
    """Index + one-hot (all levels, unseen kept) + numerics + scaling."""
    cats = CONNECTION_CATEGORICAL
    encoder = OneHotEncoder(
        inputCols=[f"{c}_idx" for c in cats], outputCols=[f"{c}_vec" for c in cats],
        dropLast=False, handleInvalid="keep",
    )
    cols = [*CONNECTION_NUMERIC, *[f"{c}_vec" for c in cats]]
    return Pipeline(stages=[
        indexers(cats), encoder, assembler(cols, "features_raw", "keep"), scaler(),
    ])


def flow_stages(df: DataFrame, label: str = "label") -> Pipeline:
    """Index + one-hot (last level dropped) of the present categoricals, doubles, scaling."""
    cats = [c for c in FLOW_CATEGORICAL if c in df.columns]
    stages = []
    if cats:
        encoder = OneHotEncoder(
            inputCols=[f"{c}_idx" for c in cats], outputCols=[f"{c}_ohe" for c in cats],
            dropLast=True,
        )
        stages = [indexers(cats), encoder]
    cols = [*double_columns(df, (label,)), *[f"{c}_ohe" for c in cats]]
    return Pipeline(stages=[*stages, assembler(cols, "features_raw", "keep"), scaler()])


def csv_flow_stages(df: DataFrame, target: str = CSV_TARGET) -> Pipeline:
    """All double columns but the target, rows with gaps skipped, scaling."""
    return Pipeline(stages=[
        assembler(double_columns(df, (target,)), "features_raw", "skip"), scaler(),
    ])


def vector_size(df: DataFrame, column: str = "features") -> int:
    """Length of the vectors of a column (0 for an empty table), read off one row."""
    row = df.select(F.size(vector_to_array(column)).alias("n")).first()
    return 0 if row is None else row["n"]


# -- estimators -------------------------------------------------------------

def forest(preset: str, label: str = "label", features: str = "features",
           weight: str | None = None, **override) -> RandomForestClassifier:
    extra = {} if weight is None else {"weightCol": weight}
    return RandomForestClassifier(
        labelCol=label, featuresCol=features, **{**FOREST_PRESETS[preset], **extra, **override}
    )


def logit(preset: str, label: str = "label", features: str = "features",
          weight: str | None = None, **override) -> LogisticRegression:
    extra = {} if weight is None else {"weightCol": weight}
    return LogisticRegression(
        labelCol=label, featuresCol=features, **{**LOGIT_PRESETS[preset], **extra, **override}
    )


def boosted(preset: str, label: str = "label", features: str = "features",
            weight: str | None = None, **override) -> GBTClassifier:
    extra = {} if weight is None else {"weightCol": weight}
    return GBTClassifier(
        labelCol=label, featuresCol=features, **{**GBT_PRESETS[preset], **extra, **override}
    )


def top_features(k: int, features: str = "features", label: str = "label",
                 out: str = "sel_features", continuous: bool = True) -> UnivariateFeatureSelector:
    """The k best features by ANOVA F-test or, if not ``continuous``, by chi-squared test over the
    values as they are (at most 10,000 distinct per feature; ``selection`` has one for any values)."""
    selector = UnivariateFeatureSelector(
        featuresCol=features, labelCol=label, outputCol=out, selectionMode="numTopFeatures"
    )
    selector.setFeatureType("continuous" if continuous else "categorical")
    selector.setLabelType("categorical")
    return selector.setSelectionThreshold(k)


def ranked_logit(ranking: Ranking, k: int, reg: float, label: str = "label",
                 weight: str | None = "weight", **override) -> Pipeline:
    """``polynomial_logit`` over features that have been ranked before."""
    return Pipeline(stages=[
        ranking.slicer(k),
        PolynomialExpansion(degree=2, inputCol="sel_features", outputCol="poly_features"),
        logit("grid", label, "poly_features", weight, regParam=reg, **override),
    ])


def polynomial_logit(k: int, reg: float, label: str = "label", weight: str | None = "weight",
                     continuous: bool = True, **override) -> Pipeline:
    """k best features, all their degree-2 terms, L2 logistic regression.

    Degree 2 makes k (k + 3) / 2 terms, so k bounds the width before the expansion.
    """
    return Pipeline(stages=[
        top_features(k, label=label, continuous=continuous),
        PolynomialExpansion(degree=2, inputCol="sel_features", outputCol="poly_features"),
        logit("grid", label, "poly_features", weight, regParam=reg, **override),
    ])
