"""Numbering rows in order without sending a group to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.lookup import is_small
from ledgerloom.session import stage

CHUNK = 4096


def _with_offsets(rows: DataFrame, group: list[str], piece: list[str], offsets: DataFrame) -> DataFrame:
    keys = [*group, *piece]
    side = F.broadcast(offsets) if is_small(offsets) else offsets
    return rows.join(side, keys)


def number_pieces(rows: DataFrame, group: str, piece: list[str], local: str, name: str) -> DataFrame:
    """Add dense 1-based ``name`` per ``group``.

    ``rows`` is a stored table cut into ordered pieces (input splits or sorted
    partitions); ``local`` grows by one from row to row inside a piece.  Only one
    row per piece goes through the running sum.
    """
    counts = rows.groupBy(group, *piece).agg(F.count("*").alias("_n"), F.min(local).alias("_low"))
    order = Window.partitionBy(group).orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(
        counts.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0))).drop("_n"),
        "offsets",
    )
    return (
        _with_offsets(rows, [group], piece, offsets)
        .withColumn(name, F.col("_before") + F.col(local) - F.col("_low") + 1)
        .drop("_before", "_low", local, *piece)
    )


def number_in_order(df: DataFrame, group: str, order: Sequence[str], name: str = "seq") -> DataFrame:
    """Add dense 1-based ``name`` per ``group`` in ``order`` (a total order).

    The rows are range-partitioned on group and order together, so a group of any
    size is spread, and stored once so that both passes see the same pieces. Finding the ranges takes a pass of its own, which
    reads again what the last shuffle before it wrote: storing the rows for it would cost as much as they take.
    """
    local = F.monotonically_increasing_id()
    ordered = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    stored = stage(
        ordered.withColumn("_piece", F.spark_partition_id()).withColumn("_local", local), "ordered"
    )
    return number_pieces(stored, group, ["_piece"], "_local", name)


def batch_columns(seq: Column, batch_size: int) -> dict[str, Column]:
    """W-01: 1-based batch and 1-based position inside it."""
    if batch_size <= 0:
        raise ValueError("BATCH_SIZE inválido o no configurado")
    zero = seq - 1
    return {
        "batch_index": (F.floor(zero / batch_size) + 1).cast("int"),
        "record_index": (F.pmod(zero, F.lit(batch_size)) + 1).cast("int"),
    }


def running_sum(df: DataFrame, group: str, position: str, values: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """A-06: running totals along a dense integer position.

    Totals per chunk of positions are summed first; each window then sees at most
    ``chunk`` rows, or one row per chunk.
    """
    pieces = df.withColumn("_chunk", F.floor((F.col(position) - 1) / chunk).cast("long"))
    totals = pieces.groupBy(group, "_chunk").agg(*[F.sum(v).alias(v) for v in values])
    earlier = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        group, "_chunk", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_before_{v}") for v in values]
    )
    inside = (
        Window.partitionBy(group, "_chunk")
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        pieces.join(before, [group, "_chunk"])
        .withColumns({f"running_{v}": F.col(f"_before_{v}") + F.sum(v).over(inside) for v in values})
        .drop("_chunk", *[f"_before_{v}" for v in values])
    )

