"""Keyed replacement of rows in stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_per_key(df: DataFrame, key: str, newest_first: Sequence[Column]) -> DataFrame:
    """W-05: the last writer per key.

    Filtering on rank 1 lets Spark keep one row per key in every map task before
    the shuffle, so a hot key does not travel whole.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*newest_first))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """K-01: whole-row replacement; ``new`` is unique on ``key``.  Write the result to a new place."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def upsert_policies(existing: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """K-06: replace documents by name; ``created_at`` stays, ``updated_at`` moves."""
    kept = existing.select("name", F.col("created_at").alias("_created"))
    fresh = (
        new.select("name", "policies")
        .join(kept, "name", "left")
        .select("name", "policies", F.coalesce("_created", now).alias("created_at"), now.alias("updated_at"))
    )
    return upsert(existing, fresh, "name")
