"""Parquet flows: a class-wise sample of a very large table to scaled vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.operators.features import flow_features, label_flows
from sluiceway.operators.sampling import sample_by, split_drawn
from sluiceway.operators.stages import flow_stages
from sluiceway.operators.stats import class_counts
from sluiceway.operators.weights import with_binary_weights, with_fixed_weight
from sluiceway.sources import lineage_cut, read_available, save_model, write_parts
from sluiceway.specs import FLOW_COLUMNS, FLOW_SAMPLE_FRACTIONS, THREE_WAY, Split

_SPLIT = "split"


def sampled_flow_features(
    flows: DataFrame,
    fractions: dict[float, float] | None = None,
    seed: int = 42,
    finite_check: str = "after",
) -> DataFrame:
    """Label, class-wise sample and row features: one narrow pass from the scan."""
    labelled = label_flows(flows)
    chosen = FLOW_SAMPLE_FRACTIONS if fractions is None else fractions
    sampled = sample_by(labelled, "label", chosen, seed) if chosen else labelled
    return flow_features(sampled, "label", finite_check)


def prepare_flows(
    spark: SparkSession,
    path: str,
    out: str,
    fractions: dict[float, float] | None = None,
    seed: int = 42,
    split: Split = THREE_WAY,
    fit_on: str = "train",
    weighting: str = "balanced",
    finite_check: str = "after",
    files: int | None = None,
    spread: bool = False,
) -> dict:
    """Sample before all feature work, derive, encode, scale, weigh; one table by split.

    The sampled features with their part are written once to the shared folder, which
    freezes the draws. ``weighting="fixed"`` gives attacks 10.0; ``"balanced"`` weighs by
    the class counts of the sample. ``fit_on="all"`` fits encoders and scaling on all rows.
    """
    if weighting not in ("balanced", "fixed"):
        raise ValueError("weighting must be 'balanced' or 'fixed'")
    if fit_on not in ("train", "all"):
        raise ValueError("fit_on must be 'train' or 'all'")
    flows = read_available(spark, path, FLOW_COLUMNS, required=("attack",))
    features = sampled_flow_features(flows, fractions, seed, finite_check)
    sample = lineage_cut(split_drawn(features, split, _SPLIT), spread=spread)
    fit_rows = sample
    if fit_on == "train":
        fit_rows = sample.filter(F.col(_SPLIT) == next(iter(split.parts)))
    model = flow_stages(sample).fit(fit_rows)
    vectors = model.transform(sample).select("features", "label", _SPLIT)
    weighted = (
        with_fixed_weight(vectors, "label") if weighting == "fixed"
        else with_binary_weights(vectors, "label", counts_from=sample, name="class_weight")
    )
    write_parts(weighted, f"{out}/flows", _SPLIT, split.parts, files)
    save_model(model, f"{out}/stages")
    written = spark.read.parquet(f"{out}/flows")
    return {"flows": written, "distribution": class_counts(written, ["label"]), "stages": model}
