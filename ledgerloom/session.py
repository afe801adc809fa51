"""Shared storage for intermediate tables.

Tables that cut a plan's lineage are written as Parquet under the folder the
cluster names in ``spark.checkpoint.dir``.  Only a local session (tests, laptop)
may fall back to a fresh folder of its own.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
CODEC = "zstd"
_scopes = threading.local()  # streams run their micro-batches on threads of their own


# Generated methods above 8000 bytes are never compiled by the JVM; Spark's own limit is higher.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # rows that meet a side with small partitions are not sorted for it
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
}


def tune(spark: SparkSession) -> SparkSession:
    """Set the recommended values the cluster has not chosen itself."""
    chosen = {k for k, _ in spark.sparkContext.getConf().getAll()}
    for key, value in RECOMMENDED.items():
        if key not in chosen:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _local_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/ledgerloom/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Write ``df`` as Parquet.

    With ``partition_by`` the rows are rebalanced on those columns first, so a
    partition value with few rows gets one file and a hot one gets many. With zstd a table takes about
    two thirds of the default's bytes.
    """
    with released_shuffles(df.sparkSession):
        if partition_by:
            df.hint("rebalance", *partition_by).write.option("compression", CODEC).partitionBy(*partition_by).parquet(path)
        else:
            df.write.option("compression", CODEC).parquet(path)
    return path


OPEN_FILES = 32


@contextmanager
def _setting(spark: SparkSession, key: str, value: str | int) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def unsorted_groups(spark: SparkSession) -> AbstractContextManager[None]:
    """Writes with ``partitionBy`` keep a file open per group instead of sorting wide rows by group, which spills.

    A task with more than ``OPEN_FILES`` groups sorts the rows of the others.
    """
    return _setting(spark, "spark.sql.maxConcurrentOutputFileWriters", OPEN_FILES)


def released_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """What a write inside has shuffled is deleted once it is written, and not when the driver's memory is next cleaned up."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it as a table scan."""
    path = new_path(df.sparkSession, name)
    if getattr(_scopes, "open", None):
        _scopes.open[-1].append(path)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table's folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end: write the result to its place before.

    Runs that return a table to be read later (the registered queries) stage outside of any scope;
    their folders stay until the application's shared folder is cleared.
    """
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    _scopes.open.append([])
    try:
        yield
    finally:
        for path in _scopes.open.pop():
            remove(spark, path)
