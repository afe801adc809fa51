"""W-06: a page far down a sorted table without sorting what comes before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHALLOW = 10_000
# microseconds: a day, an hour, a minute, a second, a millisecond, one
STEPS = (86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000, 1_000, 1)
PREFIXES = (2, 4, 6, 8)


def newest_first(rows: DataFrame, offset: int, size: int, ts: str = "created_at", tie: str = "job_id", shallow: int = SHALLOW) -> DataFrame:
    """``size`` rows from ``offset`` on, by ``ts`` descending, then by the hexadecimal text ``tie``.

    A shallow page is a top-k.  For a deep one, counts per day, hour and so on down to the microsecond, then per prefix
    of ``tie``, lead to the bucket that the page starts in; each level counts the rows of one bucket only.
    What is left is a top-k again.
    """
    order = [F.col(ts).desc(), F.col(tie)]
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    inside, start = F.lit(True), F.lit(True)
    for step in STEPS:
        if offset <= shallow:
            break
        key = F.floor(micros / step).cast("long") if step > 1 else micros
        found = _bucket(rows.where(inside), key, offset, descending=True)
        if found is None:
            return rows.limit(0)
        value, before = found
        offset -= before
        if value is None:
            inside = start = F.col(ts).isNull()
            break
        inside = inside & (key == value)
        start = (micros < (value + 1) * step) | F.col(ts).isNull()
    for length in PREFIXES:
        if offset <= shallow:
            break
        key = F.substring(tie, 1, length)
        found = _bucket(rows.where(inside), key, offset, descending=False)
        if found is None:
            return rows.limit(0)
        value, before = found
        offset -= before
        start = start & (~inside | (key >= value))
        inside = inside & (key == value)
    return rows.where(start).orderBy(*order).offset(offset).limit(size)


def _bucket(rows: DataFrame, key, offset: int, descending: bool) -> tuple[object, int] | None:
    """The bucket that holds row ``offset``, and how many rows come before it."""
    counts = rows.groupBy(key.alias("key")).count()
    order = F.col("key").desc_nulls_last() if descending else F.col("key").asc_nulls_first()
    before = 0
    for r in counts.orderBy(order).collect():  # a day's hours, an hour's minutes ...
        if before + r["count"] > offset:
            return r["key"], before
        before += r["count"]
    return None
