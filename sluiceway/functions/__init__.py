"""Column -> Column helpers: native Spark expressions only."""

from sluiceway.functions.flow import (
    asymmetry,
    bucket_port,
    bucket_protocol,
    clipped_log1p,
    diff_sum,
    duration_seconds,
    flag_bits,
    safe_ratio,
)
from sluiceway.functions.hashing import hash_bucket, hash_fold, uniform
from sluiceway.functions.labels import (
    binary_label,
    category_map,
    clean_label,
    label_from_flag,
)
from sluiceway.functions.parsing import (
    as_double,
    coerce_double,
    is_finite,
    nonfinite_to_null,
    text_to_double,
)
from sluiceway.functions.scores import (
    attack_score,
    class_probability,
    soft_vote,
    threshold_predict,
)

__all__ = [
    "as_double", "asymmetry", "attack_score", "binary_label", "bucket_port", "bucket_protocol",
    "category_map", "class_probability", "clean_label", "clipped_log1p", "coerce_double",
    "diff_sum", "duration_seconds", "flag_bits", "hash_bucket", "hash_fold", "is_finite",
    "label_from_flag", "nonfinite_to_null", "safe_ratio", "soft_vote", "text_to_double",
    "threshold_predict", "uniform",
]
