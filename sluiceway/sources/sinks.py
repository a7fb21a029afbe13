"""Writers, literal tables and model persistence."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.sources.workspace import balanced, remove_folder


def write_table(
    df: DataFrame,
    path: str,
    files: int | None = None,
    codec: str = "snappy",
    partition_by: list[str] | None = None,
    even: bool = False,
) -> str:
    """Overwrite a parquet table.

    ``files`` is the number of files of a small result, in one extra shuffle of its rows, so that the
    stage before keeps all its tasks. ``even`` sizes files by the session's advisory partition size
    instead, whatever the size of the table; rows of one partition value stay together as far as that
    size allows.
    """
    out = df if files is None else df.repartition(files)
    if even:
        out = balanced(df, *(partition_by or []))
    writer = out.write.mode("overwrite").option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def write_parts(df: DataFrame, path: str, key: str, values: Iterable[str], files: int | None = None,
                codec: str = "snappy") -> str:
    """Overwrite a parquet table partitioned by a text column of a few known values.

    Every part is a pass of its own over ``df``, which should be cheap to read again, so rows go to their
    files as they come; one pass for all parts would have every task sort its rows by part, on disk
    where they are many. Rows with other values are not written.
    """
    remove_folder(df.sparkSession, path)
    for value in values:
        part = df.filter(F.col(key) == value).drop(key)
        at = "".join(f"%{ord(c):02X}" if c < " " or c in "\"#%'*/:=?\\{[]^\x7f" else c for c in value)
        write_table(part, run_path(path, **{key: at}), files, codec)
    return path


def write_partitions(df: DataFrame, path: str, keys: list[str], codec: str = "snappy") -> str:
    """Write into a table partitioned by the keys; only partitions that the rows belong to are
    replaced, so a rerun of one run leaves the others as they are. Without rows nothing changes."""
    writer = balanced(df, *keys).write.mode("overwrite").option("compression", codec)
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    return path


def run_path(root: str, **keys: str) -> str:
    """``root/k1=v1/k2=v2``: found again as partition columns when the root is read."""
    return "/".join([root.rstrip("/"), *[f"{k}={v}" for k, v in keys.items()]])


def write_run(df: DataFrame, root: str, files: int | None = None, **keys: str) -> str:
    """Write under ``k=v`` directories; the keys are dropped from the files themselves.

    Replaces that run only. For runs of several keys at once there is ``write_partitions``.
    """
    return write_table(df.drop(*keys), run_path(root, **keys), files)


def save_model(model, path: str) -> str:
    """Overwrite-save a fitted model or pipeline."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str, cls=PipelineModel):
    """Load a fitted model; pipelines unless another model class is given."""
    return cls.load(path)


def small_table(spark: SparkSession, rows: Iterable[tuple], schema: str | T.StructType) -> DataFrame:
    """A literal table (weights, thresholds, metrics)."""
    return spark.createDataFrame(list(rows), schema)


def stamp(df: DataFrame, name: str = "saved_at") -> DataFrame:
    """Add the save time."""
    return df.withColumn(name, F.current_timestamp())
