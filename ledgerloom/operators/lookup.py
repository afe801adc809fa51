"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import stage

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
HOT_ROWS = 1_000_000
FEW_PARTITIONS = 16
SALTS = 64


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """``df.where(condition)`` for conditions on costly computed columns.

    A plain filter is moved below the projections it reads from, where each column is
    replaced by its whole expression and everything is computed twice.  A filter on
    the output of a generator stays where it is written.
    """
    hit = F.when(condition, F.array(F.lit(True)))
    return df.withColumn("_keep", F.explode_outer(hit)).where(F.col("_keep")).drop("_keep")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Share an input of a few small files among some cores.

    One small file would leave the row-wise work to one task.  Inputs of ``FEW_PARTITIONS``
    or more pass unchanged, whatever the size of the cluster.
    """
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, FEW_PARTITIONS)
    return df.repartition(wanted, *keys) if df.rdd.getNumPartitions() < wanted else df


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Reads at most ``limit + 1`` rows to learn whether ``df`` may be broadcast: by rows and by bytes of text."""
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    rows, held = df.limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return rows <= limit and held <= size


def dimension_join(
    rows: DataFrame,
    dimension: DataFrame,
    keys: Sequence[str],
    spread: Sequence[Column],
    how: str = "left",
    limit: int = BROADCAST_ROWS,
    salts: int = SALTS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``rows`` with a dimension that is unique on ``keys``.

    A dimension of at most ``limit`` rows and ``BROADCAST_BYTES`` is broadcast.  Beyond, both sides meet
    on the keys; only keys with more than ``hot_rows`` rows have their dimension row repeated
    once per salt and their rows spread over the salts.
    """
    keys = list(keys)
    if is_small(dimension, limit):
        return rows.join(F.broadcast(dimension), keys, how)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
    hot = stage(counts.select(*keys, F.lit(True).alias("_hot")), "hot-keys")
    if hot.isEmpty():
        return rows.join(dimension, keys, how)
    hot = F.broadcast(hot) if is_small(hot) else hot
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    salted = rows.join(hot, keys, "left").withColumn("_salt", salt).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = dimension.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def group_join(
    rows: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    size: str,
    spread: Column,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left join rows with facts about their own group.

    ``groups`` has one row per key with its row count in ``size``; ``spread`` is a
    positive LONG that differs between rows.  Groups above ``hot_rows`` number at
    most ``count(rows) / hot_rows``; they are broadcast if that is few, and their rows go through
    the shuffle under a key of their own and land evenly.  All other groups join on
    their key.  The groups are stored, as several joins read them.
    """
    keys = list(keys)
    groups = stage(groups, "groups")
    facts = [c for c in groups.columns if c not in keys]
    hot = groups.where(F.col(size) > hot_rows).select(*keys, F.struct(*facts).alias("_hot"))
    cold = (
        groups.where(F.col(size) <= hot_rows)
        .select(*keys, F.struct(*facts).alias("_cold"))
        .withColumn("_salt", F.lit(0).cast("long"))
    )
    marked = rows.join(F.broadcast(hot) if is_small(hot) else hot, keys, "left").withColumn(
        "_salt", F.when(F.col("_hot").isNotNull(), spread).otherwise(F.lit(0).cast("long"))
    )
    joined = marked.join(cold, [*keys, "_salt"], "left")
    return joined.select(
        *rows.columns,
        *[F.coalesce(F.col("_hot")[f], F.col("_cold")[f]).alias(f) for f in facts],
    )
