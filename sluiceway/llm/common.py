"""What several operators share: columns without clashes, global ranks, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sluiceway.sources import lineage_cut

WORD = r"[^\x20\x09-\x0D]+"


def text_of(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(quoted(name).cast("string"), F.lit(""))


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def packed(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The text column as compressed bytes, for joins that move whole texts; ``unpacked`` reads it."""
    at = df.columns.index(text_col)
    fields = [f"`{n}` {'binary' if n == text_col else t}" for n, t in df.dtypes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = batch.column(at).cast(pa.large_binary())
            small = [press(x.as_buffer()) if x.is_valid else None for x in texts]
            yield batch.set_column(at, text_col, pa.array(small, pa.binary()))

    return df.mapInArrow(run, ", ".join(fields))


def unpacked(column: pa.Array) -> Iterator[bytes]:
    """The texts of a packed column; null as empty."""
    open_ = zstandard.ZstdDecompressor().decompress
    for x in column:
        yield open_(x.as_buffer()) if x.is_valid else b""


def restored(df: DataFrame, schema: StructType, text_col: str = "text") -> DataFrame:
    """A packed table with its texts again; nulls stay nulls."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts = [open_(x.as_buffer()).decode() if x.is_valid else None for x in batch.column(at)]
            yield batch.set_column(at, text_col, pa.array(texts, pa.string()))

    return df.mapInArrow(run, schema)


def split_count(df: DataFrame, per_part: int, rows: int) -> int:
    """Parts of about ``per_part`` rows, at least one for each shuffle partition of the session."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-rows // per_part))


def ranked(df: DataFrame, order: list[str], parts: int, name: str = "rank") -> DataFrame:
    """Adds the 0-based position of every row in the order of the given columns.

    Rows are dealt out by ranges, numbered within a range and shifted by the counts of the ranges
    before: no task sees more than its range, also if one value holds most rows (name a unique
    column last). Only one count per range goes through a single task.
    """
    spread = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # High bits: partition, low 33 bits: place in it. Frozen in a table before it is used twice.
    spread = lineage_cut(spread.withColumn("_mono", F.monotonically_increasing_id()))
    sized = spread.groupBy(F.shiftrightunsigned("_mono", 33).alias("_part")).count()
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sized.select(
        "_part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before")
    )
    place = F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        spread.withColumn("_part", F.shiftrightunsigned("_mono", 33))
        .join(F.broadcast(before), "_part")  # one row per range
        .withColumn(name, (F.col("_before") + place).cast("long"))
        .drop("_part", "_before", "_mono")
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): every node that has an edge, with the smallest node it can reach.

    Alternates two rounds of grouped minima: nodes larger than a node are hung under the smallest
    neighbour, then smaller ones are. Every round is a table in the shared folder. Only minima are
    taken per node, so a node with very many edges costs its tasks no memory.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v")
    links = lineage_cut(links.distinct())
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m")
        )
        large = (
            both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), "m")
            .distinct()
        )
        large = lineage_cut(large.withColumnRenamed("m", "v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                      F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
                    .alias("e"))
            .select("e.u", "e.v").filter("u <> v").distinct()
        )
        small = lineage_cut(small)
        # Done when every node hangs under one root and no root hangs under another.
        nodes, roots = small.groupBy("u").count(), small.select(F.col("v").alias("u")).distinct()
        open_nodes = nodes.filter("count > 1").limit(1).count()
        if not open_nodes and not nodes.join(roots, "u", "left_semi").limit(1).count():
            labels = small.select(F.col("u").alias("node"), F.col("v").alias("label"))
            own = roots.select(F.col("u").alias("node"), F.col("u").alias("label"))
            return labels.union(own)
        links = small
