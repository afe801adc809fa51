"""Text functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.constants import WHITESPACE


ASCII_WHITESPACE = "".join(c for c in WHITESPACE if c.isascii())


def trim(c: Column) -> Column:
    """Remove every kind of blank at both ends, not only spaces.

    The search per character grows with the set, so plain text gets the short one.
    """
    return F.when(F.octet_length(c) == F.length(c), F.btrim(c, F.lit(ASCII_WHITESPACE))).otherwise(
        F.btrim(c, F.lit(WHITESPACE))
    )


def str_field(c: Column) -> Column:
    """F-03: null becomes '', then trim."""
    return trim(F.coalesce(c, F.lit("")))


def safe_name(c: Column) -> Column:
    """F-23: every unit outside ``[A-Za-z0-9._-]`` becomes ``_``.

    Characters beyond the basic plane count as two units.
    """
    wide = F.regexp_replace(c, r"[\x{10000}-\x{10FFFF}]", "__")
    return F.regexp_replace(wide, "[^A-Za-z0-9._-]", "_")


def is_csv_name(c: Column) -> Column:
    """S-02: admission by file name."""
    return F.lower(c).endswith(".csv")


def json_string(c: Column) -> Column:
    """``c`` as a quoted JSON string."""
    wrapped = F.to_json(F.struct(c.alias("s")))
    escaped = F.substr(wrapped, F.lit(6), F.length(wrapped) - 6)
    return F.when(c.rlike(r'["\\\x00-\x1f]'), escaped).otherwise(
        F.concat(F.lit('"'), c, F.lit('"'))
    )


def compose_result(status: Column, messages: Column) -> Column:
    """F-21: ``STATUS|sin alertas`` or ``STATUS|m1||m2``."""
    tail = F.when(F.size(messages) == 0, F.lit("sin alertas")).otherwise(
        F.array_join(messages, "||")
    )
    return F.concat(status, F.lit("|"), tail)


def parse_result(text: Column, first_only: bool = False) -> Column:
    """F-22: ``struct<status, alertas>`` of a composed result text.

    ``first_only`` keeps just the part between the first two bars, which is all
    that a split on single bars can see.
    """
    status = trim(F.substring_index(text, "|", 1))
    bar = F.instr(text, "|")
    if first_only:
        rest = F.coalesce(F.try_element_at(F.split(text, r"\|"), F.lit(2)), F.lit(""))
    else:
        rest = F.when(bar > 0, F.substr(text, bar + 1)).otherwise(F.lit(""))
    none = trim(rest).isin("", "sin alertas")
    alerts = F.when(none, F.array().cast("array<string>")).otherwise(
        F.transform(F.split(rest, r"\|\|"), trim)
    )
    return F.when(text.isNotNull() & (text != ""), F.struct(status.alias("status"), alerts.alias("alertas")))
