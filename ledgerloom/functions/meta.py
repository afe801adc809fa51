"""Audit metadata: JSON access, typed merge, and labels derived from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.constants import FAILED, PENDIENTE, SKIPPED, SUCCESS


def meta_path(meta_json: Column, *keys: str) -> Column:
    """F-28: text at a nested key of a JSON column."""
    return F.get_json_object(meta_json, "$" + "".join(f"['{k}']" for k in keys))


def meta_has(meta_json: Column, key: str) -> Column:
    """F-28: does the JSON object have this key?"""
    return F.coalesce(F.array_contains(F.json_object_keys(meta_json), key), F.lit(False))


def merge_meta(meta: Column, patch: Column) -> Column:
    """F-29: shallow merge of two maps; keys of the patch win."""
    kept = F.map_filter(meta, lambda k, _: ~F.map_contains_key(patch, k))
    return F.map_concat(kept, patch)


def set_meta(meta: Column, **fields: Column) -> Column:
    """F-29 on typed metadata: replace fields of the struct."""
    for name, value in fields.items():
        meta = meta.withField(name, value)
    return meta


def effective_status(expense_status: Column, meta_status: Column) -> Column:
    """F-30"""
    return F.upper(F.coalesce(expense_status, meta_status, F.lit(PENDIENTE)))


def result_label(run_status: Column, validation_status: Column) -> Column:
    """F-31"""
    return (
        F.when(run_status == SUCCESS, F.coalesce(validation_status, F.lit(PENDIENTE)))
        .when(run_status == FAILED, F.coalesce(validation_status, F.lit("ERROR")))
        .when(run_status == SKIPPED, F.lit("OMITIDO"))
        .otherwise(F.lit("EN_PROCESO"))
    )


def display_status(run_status: Column, meta_status: Column) -> Column:
    """F-32"""
    return F.coalesce(F.upper(meta_status), run_status)
