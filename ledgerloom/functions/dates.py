"""Calendar functions."""

from __future__ import annotations

from datetime import date, datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_day(as_of: datetime | date | None, tz: str = "UTC") -> date:
    """Calendar day of an instant in the application time zone."""
    if as_of is None:
        as_of = datetime.now(timezone.utc)
    if isinstance(as_of, datetime):
        if as_of.tzinfo is None:
            as_of = as_of.replace(tzinfo=timezone.utc)
        return as_of.astimezone(ZoneInfo(tz)).date()
    return as_of


def real_date(fecha: Column) -> Column:
    """``yyyy-mm-dd`` text to DATE; null when the text or the day does not exist."""
    return F.when(fecha.rlike(r"^\d{4}-\d{2}-\d{2}$"), fecha.try_cast("date"))


def day_gap(fecha: Column, today: date) -> Column:
    """Calendar days from ``fecha`` to ``today``; negative ahead of it, null for a bad date."""
    return F.datediff(F.lit(today), real_date(fecha))


def days_since(gap: Column) -> Column:
    """F-19: a future date has age 0."""
    return F.when(gap < 0, F.lit(0)).otherwise(gap)
