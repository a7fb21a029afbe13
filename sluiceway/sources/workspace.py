"""Shared scratch folder, lineage cuts and scoped caching."""

from __future__ import annotations

import threading
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writers, _before, _writers_lock = Counter(), {}, threading.Lock()
_open_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("open_scopes", default=())


def _checkpoint_root(spark: SparkSession) -> str:
    """The folder the session names; without one, a folder of the warehouse, which is shared too."""
    configured = spark.conf.get(_CHECKPOINT_KEY, None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def shared_dir(spark: SparkSession, name: str = "work") -> str:
    """A new folder name below the shared folder that the session names."""
    path = f"{_checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for made in _open_scopes.get()[-1:]:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that are named within the block are removed at its end, also if it fails.

    Read or write what a plan returns inside the block: its tables are gone afterwards. Scopes nest;
    a folder belongs to the innermost one. Removal goes through the Hadoop file system of each path.
    Threads that the block starts see the scope only if they run in a copy of its context.
    """
    made: list[str] = []
    token = _open_scopes.set((*_open_scopes.get(), made))
    try:
        yield
    finally:
        _open_scopes.reset(token)
        for path in made:
            remove_folder(spark, path)


def remove_folder(spark: SparkSession, path: str) -> bool:
    """Delete a folder with all it holds; False if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def balanced(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out into partitions by size: adaptive execution splits those beyond the session's
    advisory size and joins small ones. With keys, equal ones stay together as far as that size
    allows."""
    return df.hint("rebalance", *keys)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write within the block go when it ends, not when the driver's garbage collection
    finds that nobody names them, which in long jobs can be hours later. The session's setting is as before
    after the last of the blocks that are open at one time."""
    session = spark._jsparkSession.sessionUUID()
    with _writers_lock:
        if not _writers[session]:
            _before[session] = spark.conf.get(_CLEANUP_KEY, None)
            spark.conf.set(_CLEANUP_KEY, "true")
        _writers[session] += 1
    try:
        yield
    finally:
        with _writers_lock:
            _writers[session] -= 1
            if not _writers[session]:
                del _writers[session]
                was = _before.pop(session)
                if was is None:
                    spark.conf.unset(_CLEANUP_KEY)
                else:
                    spark.conf.set(_CLEANUP_KEY, was)


def lineage_cut(df: DataFrame, how: str = "table", spread: bool = False) -> DataFrame:
    """Compute once, into the shared folder, and go on from there.

    ``spread`` evens out the rows by size first: for input in a few large row groups that
    iterative fits will read many times. Leave it out for input with many splits. A table that comes
    to fewer partitions than there are cores is dealt out to all of them when it is read.

    The result survives the loss of executors and freezes drawn or numbered values. A
    parquet table lets later passes read only their columns; ``how="checkpoint"`` uses
    Spark's reliable checkpoint instead.
    """
    spark = df.sparkSession
    if spread:
        df = balanced(df)
    if how == "checkpoint":
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(_checkpoint_root(spark))
        return df.checkpoint(eager=True)
    if how != "table":
        raise ValueError("how must be 'table' or 'checkpoint'")
    path = shared_dir(spark, "cut")
    with shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return out.repartition(cores) if spread and out.rdd.getNumPartitions() < cores else out


@contextmanager
def persisted(*dfs: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator:
    """Persist for the length of a block and always release."""
    cached = [df.persist(level) for df in dfs]
    try:
        yield cached[0] if len(cached) == 1 else tuple(cached)
    finally:
        for df in cached:
            df.unpersist()
