"""Fingerprints and deterministic ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.constants import FINGERPRINT_FIELDS, NUMERIC
from ledgerloom.functions.numbers import js_number
from ledgerloom.functions.text import json_string


def fingerprint(fields: Sequence[str] = FINGERPRINT_FIELDS) -> Column:
    """F-09/F-11: SHA-256 over the JSON text of ``fields``, in the given order."""
    parts: list[Column] = []
    for position, name in enumerate(fields):
        lead = "{" if position == 0 else ","
        value = js_number(name) if name in NUMERIC else json_string(F.col(name))
        parts += [F.lit(f'{lead}"{name}":'), F.coalesce(value, F.lit("null"))]
    return F.sha2(F.concat(*parts, F.lit("}")), 256)


def dedup_key(process_id: Column, print_: Column) -> Column:
    """F-10: scoped to the process when there is one."""
    return F.concat_ws(":", process_id, print_)


def job_id(process_id: Column, batch_index: Column, record_index: Column) -> Column:
    """One id per record position, the same on every replay."""
    return F.sha2(
        F.concat_ws("|", process_id, batch_index.cast("string"), record_index.cast("string")), 256
    )


def arrival(batch_index: Column, record_index: Column) -> Column:
    """Order of a record inside its process as one LONG."""
    return F.shiftleft(batch_index.cast("long"), 31) + record_index.cast("long")
