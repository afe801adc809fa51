"""W-04 strict mode: a failing record stops the rest of its batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.identity import arrival
from ledgerloom.session import stage

BATCH = ["process_id", "batch_index"]


def _first_errors(rows: DataFrame) -> DataFrame:
    """First failing record per batch, if only ``rows`` were processed.

    A duplicate exits before it can fail, so only the first arrival of each
    fingerprint counts.  ``error`` depends on content, but not on the fingerprint
    alone; it travels in the last bit of the smallest arrival.
    """
    code = arrival(F.col("batch_index"), F.col("record_index")) * 2 + F.col("error").cast("long")
    firsts = rows.groupBy("process_id", "fingerprint").agg(F.min(code).alias("_code"))
    position = F.shiftright("_code", 1)
    return (
        firsts.where(F.col("_code") % 2 == 1)
        .select(
            "process_id",
            F.shiftright(position, 31).cast("int").alias("batch_index"),
            F.pmod(position, F.lit(1 << 31)).cast("int").alias("record_index"),
        )
        .groupBy(*BATCH)
        .agg(F.min("record_index").alias("first_error"))
    )


def cut_at(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows up to and including the first error of their batch.  A batch is bounded by its size."""
    return (
        rows.join(cuts, BATCH, "left")
        .where(F.col("first_error").isNull() | (F.col("record_index") <= F.col("first_error")))
        .drop("first_error")
    )


def abort_batches(rows: DataFrame) -> DataFrame:
    """The cut of every aborted batch: process_id, batch_index, first_error.

    Removing rows makes later copies of their fingerprints first arrivals, so cut
    and dedup repeat until the cuts stay the same.  Every round settles at least one
    more batch per process, so the rounds end, and the stable state is unique.  ``rows`` needs
    process_id, batch_index, record_index, fingerprint and boolean ``error``.
    """
    narrow = stage(rows.select(*BATCH, "record_index", "fingerprint", "error"), "abort-rows")
    cuts = stage(_first_errors(narrow), "abort-cuts")
    while True:
        again = stage(_first_errors(cut_at(narrow, cuts)), "abort-cuts")
        # a batch has one cut: equal numbers and none without its equal mean equal tables
        same = again.count() == cuts.count() and again.join(cuts, [*BATCH, "first_error"], "left_anti").isEmpty()
        cuts = again
        if same:
            return cuts
