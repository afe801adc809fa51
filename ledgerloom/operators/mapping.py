"""From raw columns or raw key/value records to the canonical expense."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.constants import ALIASES, NUMERIC, REQUIRED
from ledgerloom.functions.numbers import parse_number
from ledgerloom.functions.text import str_field, trim
from ledgerloom.operators.lookup import keep_where

LINEAGE = ("process_id", "process_seq", "batch_index", "record_index", "created_at")


def normalize_columns(columns: Sequence[str]) -> dict[str, str]:
    """F-01: trimmed lower-case name -> source column; a later clash wins."""
    return {name.strip().lower(): name for name in columns}


def blank_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """An empty cell of a file is '' and counts as present, never null."""
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in columns})


def pick(index: dict[str, str], field: str) -> Column:
    """F-02: first alias with a non-null cell."""
    present = [F.col(f"`{index[a]}`") for a in ALIASES[field] if a in index]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def normalized_record(record: Column) -> Column:
    """F-01 on a record of its own keys: ``map`` under trimmed lower-case keys, a later clash wins."""
    keys = F.transform(F.map_keys(record), lambda k: F.lower(trim(k)))
    values = F.map_values(record)
    pairs = F.arrays_zip(F.reverse(keys).alias("k"), F.reverse(values).alias("v"))
    last = F.filter(pairs, lambda p, i: F.array_position(F.reverse(keys), p["k"]) == i + 1)
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_arrays(keys, values)).otherwise(
        F.map_from_entries(last)
    )


def pick_key(record: Column, field: str) -> Column:
    """F-02 on a normalized record."""
    return F.coalesce(*[F.try_element_at(record, F.lit(a)) for a in ALIASES[field]])


def _canonical(pick_field) -> dict[str, Column]:
    return {
        f: parse_number(pick_field(f)) if f in NUMERIC else str_field(pick_field(f)) for f in ALIASES
    }


def missing_fields() -> Column:
    """F-05: names of required fields that are absent, in order."""
    return F.array_compact(
        F.array(
            *[
                F.when(F.col(f).isNull() if f in NUMERIC else F.col(f) == "", F.lit(f))
                for f in REQUIRED
            ]
        )
    )


def is_valid() -> Column:
    """P-01: every required field is there."""
    checks = [F.col(f).isNotNull() if f in NUMERIC else F.col(f) != "" for f in REQUIRED]
    return reduce(lambda a, b: a & b, checks)


def missing_message(columns: Sequence[str]) -> Column:
    """F-05: the text of an invalid record; names at most the first 30 columns."""
    shown = ", ".join(columns[:30]) + ("..." if len(columns) > 30 else "")
    return F.concat(
        F.lit("Registro inválido: faltan campos requeridos ("),
        F.array_join("missing", ", "),
        F.lit(f"). Columnas recibidas: {shown}"),
    )


def map_columns(
    raw: DataFrame, source_columns: Sequence[str], keep: Sequence[str] = (), blank: bool = True
) -> DataFrame:
    """F-01..F-06 for a wide table of text cells; ``keep`` names columns to carry along.

    Without ``blank`` a null cell is a column that the record's file does not have.
    """
    index = normalize_columns(source_columns)
    mapped = blank_cells(raw, source_columns) if blank else raw
    lineage = [c for c in LINEAGE if c in raw.columns]
    fields = _canonical(lambda f: pick(index, f))
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in source_columns]))
    return mapped.select(
        *lineage, *[e.alias(f) for f, e in fields.items()], row.alias("csv_row"), *keep
    )


def map_records(events: DataFrame, record: str = "record", keep: Sequence[str] = ()) -> DataFrame:
    """F-01..F-06 for key/value records (``map<string,string>``); ``keep`` names columns to carry along."""
    lineage = [c for c in LINEAGE if c in events.columns]
    fields = _canonical(lambda f: pick_key(F.col("_record"), f))
    return (
        events.withColumn("_record", normalized_record(F.col(record)))
        .select(*lineage, *[e.alias(f) for f, e in fields.items()], F.to_json(record).alias("csv_row"), *keep)
    )


def valid(mapped: DataFrame) -> DataFrame:
    """P-01: records with every required field. The columns are costly to compute twice."""
    return keep_where(mapped, is_valid())


def valid_records(mapped: DataFrame) -> DataFrame:
    """P-01 after ``map_records``."""
    return valid(mapped)


def quarantined(mapped: DataFrame, columns: Sequence[str]) -> DataFrame:
    """P-01: the other records, with the reason."""
    return (
        mapped.where(~is_valid())
        .withColumn("missing", missing_fields())
        .withColumn("error", missing_message(list(columns)))
    )


def batch_expense_id(columns: Sequence[str]) -> Column:
    """F-07: ``gasto_id``, else ``id``, trimmed; blank is null.

    Only these two exact column names count.
    """
    present = [F.col(f"`{c}`") for c in ("gasto_id", "id") if c in columns]
    text = str_field(F.coalesce(*present)) if present else F.lit("")
    return F.nullif(text, F.lit(""))
