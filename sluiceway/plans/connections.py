"""Connection records: headerless text to training and test vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.operators.clean import mark_connections
from sluiceway.operators.stages import connection_stages
from sluiceway.operators.stats import class_counts, stage_counts
from sluiceway.operators.unions import union_by_name
from sluiceway.sources import (
    lineage_cut,
    read_positional_csv,
    save_model,
    write_table,
)
from sluiceway.specs import CONNECTION_COLUMNS

_KEPT = "__kept"


def prepare_connections(
    spark: SparkSession, train_path: str, test_path: str, out: str
) -> dict[str, DataFrame]:
    """Fit the feature stages on the training file only and apply them to both files.

    Writes ``stages``, ``train_parquet`` and ``test_parquet`` below ``out``. Returns both
    written tables with an audit table of row counts and the class distribution. Each file is parsed
    once, into a table of its typed rows in which those out of range are marked; the audit counts that.
    """
    typed = {
        name: lineage_cut(mark_connections(read_positional_csv(spark, path, CONNECTION_COLUMNS), _KEPT))
        for name, path in (("train", train_path), ("test", test_path))
    }
    clean = {name: df.filter(_KEPT).drop(_KEPT) for name, df in typed.items()}
    model = connection_stages().fit(clean["train"])
    save_model(model, f"{out}/stages")
    for name, df in clean.items():
        vectors = model.transform(df).select(
            F.col("label_binary").alias("label"), "attack_category", "label_raw", "features"
        )
        write_table(vectors, f"{out}/{name}_parquet")
    written = {name: spark.read.parquet(f"{out}/{name}_parquet") for name in clean}
    audit = stage_counts({
        **{f"raw_{n}": df for n, df in typed.items()},
        **{f"clean_{n}": df for n, df in written.items()},
    })
    shares = union_by_name([
        class_counts(df, ["label", "attack_category"]).withColumn("part", F.lit(n))
        for n, df in written.items()
    ])
    return {**written, "audit": audit, "distribution": shares}
