"""Table readers. All return lazy DataFrames; types are never inferred from data."""

from __future__ import annotations

import csv
import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.functions.parsing import as_column, as_double
from sluiceway.specs import UFLOW_FEATURES, UFLOW_LABEL


def _text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_positional_csv(spark: SparkSession, path: str | list[str], names: list[str]) -> DataFrame:
    """Headerless comma files as text columns named by position."""
    return spark.read.schema(_text_schema(names)).csv(path, sep=",", header=False)


def normalized_names(names: list[str]) -> list[str]:
    """Trimmed names; the 2nd, 3rd … copy of a name gets ``__dup2``, ``__dup3`` …"""
    seen: dict[str, int] = {}
    out = []
    for name in (n.strip() for n in names):
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}__dup{seen[name]}")
    return out


def normalize_headers(df: DataFrame) -> DataFrame:
    """Rename all columns by position to their normalised names."""
    return df.toDF(*normalized_names(df.columns))


def _literal_path(uri: str) -> str:
    """A path for a reader from the URI of a file, its pattern characters escaped."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", unquote(uri))


def csv_layouts(spark: SparkSession, glob: str) -> DataFrame:
    """(header, paths): the header lines that the files of a glob begin with, and their files.

    One grouped scan of the lines for any number of files; per file a task keeps the line that
    comes first in the file's first block. Empty files have no header and are left out.
    """
    lines = spark.read.text(glob).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"),
    )
    first = lines.filter("start = 0").groupBy("path").agg(F.min_by("line", "place").alias("header"))
    return first.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths"))


def read_csv_union(spark: SparkSession, glob: str, malformed: str | None = None) -> DataFrame:
    """All headed CSV files of a glob as text, united by name; missing columns are null.

    Files with the same header share one scan, so jobs and plan grow with the number of layouts,
    not of files, and the driver gets the paths layout by layout. Rows with a wrong number of fields
    are dropped; with ``malformed`` they stay, with their line in a column of that name and null in
    all others, and that column is null for good rows. The parser sees whole rows whatever is
    selected later.
    """
    # Ordered by the first path, so that the order of columns does not depend on a shuffle. The header
    # is taken as text: the CSV reader would rename repeated names before they are seen here.
    found = sorted(csv_layouts(spark, glob).collect(), key=lambda r: r["paths"][0])
    if not found:
        raise ValueError(f"no lines in files that match {glob}")
    parts = []
    for row in found:
        header = next(csv.reader([row["header"].lstrip("\ufeff")]), [])
        schema = _text_schema(normalized_names(header))
        reader = spark.read.option("columnPruning", False)
        files = [_literal_path(path) for path in row["paths"]]
        if malformed is None:
            parts.append(reader.schema(schema).csv(files, header=True, mode="DROPMALFORMED"))
            continue
        if malformed.lower() in (n.lower() for n in schema.names):
            raise ValueError(f"the files have a column {malformed}")
        whole = reader.schema(schema.add(malformed, "string")).csv(
            files, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=malformed)
        # Spark refuses plans that read the line column only; this condition holds for every row.
        some = as_column(schema.names[0])
        whole = whole.filter(some.isNull() | some.isNotNull())
        good = as_column(malformed).isNull()
        parts.append(whole.select(
            *[F.when(good, as_column(n)).alias(n) for n in schema.names if n != malformed],
            as_column(malformed)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_available(
    spark: SparkSession, path: str | list[str], wanted: list[str], required: tuple[str, ...] = ()
) -> DataFrame:
    """Parquet with those of the wanted columns that exist, in the wanted order."""
    paths = [path] if isinstance(path, str) else path
    df = spark.read.parquet(*paths)
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"{path} lacks required columns {absent}")
    return df.select(*[as_column(c) for c in wanted if c in df.columns])


def read_parquet_cols(spark: SparkSession, path: str | list[str], cols: list[str]) -> DataFrame:
    """Parquet with exactly these columns; the scan reads no others."""
    paths = [path] if isinstance(path, str) else path
    return spark.read.parquet(*paths).select(*[as_column(c) for c in cols])


def uflow_from(df: DataFrame, tag: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Common flow record: 11 features and label as doubles, null and NaN to 0.0, source tag.

    ``keep`` names further columns to carry along, such as a row key or a source column.
    """
    cols = [*UFLOW_FEATURES, UFLOW_LABEL]
    out = df.select(*keep, *[as_double(c).alias(c) for c in cols]).na.fill(0.0, cols)
    return out if tag is None else out.withColumn("src_ds", F.lit(tag))


def read_uflow(spark: SparkSession, path: str, tag: str | None = None) -> DataFrame:
    """Common flow record read from parquet."""
    return uflow_from(spark.read.parquet(path), tag)
