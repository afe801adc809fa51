"""Reading the sample tables, crc32 splits, and staged intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import stage

__all__ = ["fold", "partitions", "read", "stage", "without"]

FEW_IDS = 1 << 20  # ids up to this many (8 bytes each) are sent to every task


ROWS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A sample table. Rows go to Python workers a thousand at a time unless the session says otherwise: texts are long."""
    if ROWS_PER_BATCH not in {k for k, _ in spark.sparkContext.getConf().getAll()}:
        spark.conf.set(ROWS_PER_BATCH, "1000")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % folds


def partitions(rows: int, per_partition: int) -> int:
    """As many as keep each one below a size."""
    return max(4, -(-rows // per_partition))


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """``docs`` less those with one of the ids; rows without an id stay."""
    ids = stage(ids, "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, id_col, "left_anti").select(docs.columns)
