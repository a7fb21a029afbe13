"""Model outputs to scores and predictions."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F

from sluiceway.functions.parsing import as_column


def class_probability(vector: Column | str, index: int = 1) -> Column:
    """Entry of a probability vector; null when the vector is shorter."""
    return F.get(vector_to_array(as_column(vector)), F.lit(index))


def attack_score(probabilities: Column | str, normal_index: int) -> Column:
    """1 - p[normal] from an array; 0.5 for an unknown index or a null or short array."""
    if normal_index < 0:
        return F.lit(0.5)
    p = F.get(as_column(probabilities), F.lit(normal_index)).cast("double")
    return F.coalesce(F.lit(1.0) - p, F.lit(0.5))


def soft_vote(weighted: dict[str, float]) -> Column:
    """Sum of score columns under weights scaled to sum to 1."""
    total = float(sum(weighted.values()))
    if total <= 0:
        raise ValueError("vote weights must have a positive sum")
    terms = [F.lit(w / total) * as_column(c) for c, w in weighted.items()]
    score = terms[0]
    for term in terms[1:]:
        score = score + term
    return score


def threshold_predict(score: Column | str, threshold: float = 0.5) -> Column:
    """1.0 where score >= threshold, else 0.0 (also for null)."""
    return F.when(as_column(score) >= F.lit(float(threshold)), 1.0).otherwise(0.0)
