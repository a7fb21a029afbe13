"""Exact deduplication against a persistent digest index.

The index is a parquet table bucketed and sorted by digest. A batch is reduced to one row per
digest, anti-joined with the index bucket by bucket (the index is never shuffled) and what is new is
appended. Entries already in the index win over later batches; within a batch the largest id wins.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.llm.common import quoted, text_of
from sluiceway.sources import lineage_cut, shared_dir

INDEX_BUCKETS = 64
_FIELDS = "digest binary, keep_id bigint"


@dataclass(frozen=True)
class DigestIndex:
    """A bucketed table of (digest, keep_id) at ``path``; ``name`` is its name in this session."""

    spark: SparkSession
    name: str
    path: str
    buckets: int

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int = INDEX_BUCKETS) -> DigestIndex:
        """Opens or creates the index at a path; the bucket count belongs to the path for good."""
        name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"create table {name} ({_FIELDS}) using parquet "
            f"clustered by (digest) sorted by (digest) into {buckets} buckets location '{path}'"
        )
        return cls(spark, name, path, buckets)

    @classmethod
    def create(cls, spark: SparkSession) -> DigestIndex:
        """A new index in the shared folder, of as many buckets as the session has shuffle partitions, 64 at
        least. A session that deals rows out more widely than an index has buckets could write every bucket
        from every task."""
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return cls.open(spark, shared_dir(spark, "digests"), max(INDEX_BUCKETS, least))

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, digests: DataFrame) -> None:
        """Appends the digests that the index lacks, each with its largest id."""
        fresh = digests.groupBy("digest").agg(F.max("id").alias("keep_id"))
        new = fresh.hint("merge").join(self.table().hint("merge"), "digest", "left_anti")
        new = new.repartition(self.buckets, "digest")  # one file per bucket and batch
        (new.write.mode("append").format("parquet").bucketBy(self.buckets, "digest")
         .sortBy("digest").option("path", self.path).saveAsTable(self.name))
        self.spark.catalog.refreshTable(self.name)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest): SHA-256 of the text in UTF-8, null as empty; written once to the shared folder."""
    return lineage_cut(docs.select(
        quoted(id_col).cast("long").alias("id"), F.unhex(F.sha2(text_of(text_col), 256)).alias("digest")
    ))


def decide(batches: list[DataFrame], index: DigestIndex) -> DataFrame:
    """One row per row of the batches: id, keep_id, group_size, kept, digest.

    Rows that share id and text are one row repeated: the first copy is kept, the others are not.
    An id of null loses against any other; a group of null ids alone keeps its first row. A hot
    digest is counted in the map tasks, and its rows meet the one row of its group in a join that
    adaptive execution can split.
    """
    rows = batches[0]
    for more in batches[1:]:
        rows = rows.union(more)
    rows = lineage_cut(rows.groupBy("id", "digest").agg(F.count("*").alias("copies")))
    sizes = rows.groupBy("digest").agg(F.sum("copies").alias("group_size"))
    groups = lineage_cut(sizes.join(index.table(), "digest"))
    return (
        rows.join(groups, "digest")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select("id", "keep_id", "group_size",
                (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                "digest")
    )


def dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Adds one batch of documents to the index and returns the decision for each of its rows.

    Null texts count as empty; other columns are not read. An empty batch gives no rows.
    """
    if index is None:
        index = DigestIndex.create(docs.sparkSession)
    batch = digests(docs, id_col, text_col)
    index.add(batch)
    return decide([batch], index)
