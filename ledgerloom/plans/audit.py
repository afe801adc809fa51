"""K-01..K-03: the stored tables, as projections of the outcome rows."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.constants import DUPLICATE, DUPLICATE_DB, FAILED, NEGATIVE, RUNNING, SKIPPED, STAGES, SUCCESS
from ledgerloom.operators.upsert import last_per_key, upsert
from ledgerloom.sources.tables import stage_id

BATCH_PATTERN = "expense.batch"
RECORD_PATTERN = "expense.created"


def meta(policy: Mapping | None = None) -> Column:
    """Typed audit metadata of a run."""
    outcome = F.col("outcome")
    duplicate = outcome.isin(DUPLICATE, DUPLICATE_DB)
    document = json.dumps(policy, ensure_ascii=False) if policy is not None else None
    return F.struct(
        "id",
        "empleado_id",
        "fecha",
        "monto_original",
        "moneda_original",
        "categoria",
        "cost_center",
        "monto_base",
        "tipo_cambio",
        "process_id",
        "batch_index",
        "record_index",
        "csv_row",
        F.when(
            duplicate,
            F.struct(F.lit(True).alias("skipped"), outcome.alias("reason"), F.col("fingerprint")),
        ).alias("dedup"),
        F.when(
            outcome == NEGATIVE,
            F.struct(F.lit(True).alias("skipped"), outcome.alias("reason"), F.col("monto_original")),
        ).alias("negative_amount"),
        F.when(
            outcome == SUCCESS,
            F.struct(
                F.col("validation_status").alias("status"),
                F.col("validation_alerts").alias("alertas"),
                F.lit(document).cast("string").alias("politicas"),
            ),
        ).alias("validation"),
    )


def job_runs(outcomes: DataFrame, policy: Mapping | None = None) -> DataFrame:
    """K-02: one audit row per record."""
    return outcomes.select(
        "job_id",
        F.when(F.col("process_id") == "", F.lit(RECORD_PATTERN)).otherwise(F.lit(BATCH_PATTERN)).alias("pattern"),
        F.col("id").alias("expense_id"),
        "fingerprint",
        F.col("run_status").alias("status"),
        F.col("created_at").alias("finished_at"),
        meta(policy).alias("meta"),
        "created_at",
        "process_id",
        "process_seq",
        "batch_index",
        "record_index",
    )


def _stage(name: str, reached: Column, state: Column, **data: Column) -> Column:
    keys = ("fingerprint", "source", "duplicate", "normalized_amount", "negative_amount_detected",
            "reason", "base_amount", "tipo_cambio", "rate_source", "status", "alertas_count", "alertas")
    types = {"duplicate": "boolean", "normalized_amount": "double", "negative_amount_detected": "boolean",
             "base_amount": "double", "tipo_cambio": "double", "alertas_count": "int",
             "alertas": "array<struct<codigo:string,mensaje:string>>"}
    payload = F.struct(
        *[data.get(k, F.lit(None)).cast(types.get(k, "string")).alias(k) for k in keys]
    )
    return F.when(
        reached,
        F.struct(
            F.lit(name).alias("stage"),
            F.lit(STAGES.index(name) + 1).alias("stage_order"),
            state.alias("status"),
            payload.alias("data"),
        ),
    )


def job_stages(outcomes: DataFrame) -> DataFrame:
    """K-03: the stages each run reached, with its position, which the ids derive from.

    A run that fails leaves the stage it failed in as ``running``.
    """
    outcome, failed_in = F.col("outcome"), F.col("failed_stage")
    passed_dedup = ~outcome.isin(DUPLICATE, DUPLICATE_DB)
    priced = passed_dedup & (outcome != NEGATIVE)
    in_validation = priced & F.coalesce(failed_in != "currency", F.lit(True))
    ok = outcome == SUCCESS

    def status(good: Column) -> Column:
        return F.when(good, F.lit(SUCCESS)).otherwise(F.lit(RUNNING))

    from_db = outcome == DUPLICATE_DB
    stages = F.array_compact(
        F.array(
            _stage(
                "dedup",
                F.lit(True),
                F.when(passed_dedup, F.lit(SUCCESS)).otherwise(F.lit(SKIPPED)),
                fingerprint=F.col("fingerprint"),
                source=F.when(from_db, F.lit("db")),
                duplicate=F.when(from_db, F.lit(True)),
            ),
            _stage(
                "normalize",
                passed_dedup,
                F.when(outcome == NEGATIVE, F.lit(SKIPPED)).otherwise(F.lit(SUCCESS)),
                negative_amount_detected=F.col("negative_amount_detected"),
                normalized_amount=F.col("monto_normalizado"),
                reason=F.when(outcome == NEGATIVE, F.lit(NEGATIVE)),
            ),
            _stage(
                "currency",
                priced,
                status(in_validation),
                base_amount=F.when(in_validation, F.col("base_amount")),
                tipo_cambio=F.when(in_validation, F.col("exchange_rate")),
                rate_source=F.when(in_validation, F.col("rate_source")),
            ),
            _stage(
                "validation",
                in_validation,
                status(ok),
                status=F.when(ok, F.col("validation_status")),
                alertas_count=F.when(ok, F.size("validation_alerts")),
                alertas=F.when(ok, F.col("validation_alerts")),
            ),
            _stage("persist", ok, F.lit(SUCCESS)),
        )
    )
    return outcomes.select(
        "job_id", "process_id", "batch_index", "record_index", "created_at", F.col("error").alias("_error"), F.explode(stages).alias("s")
    ).select(
        stage_id(F.col("job_id"), F.col("s.stage_order")).alias("id"),
        "job_id",
        "process_id",
        "batch_index",
        "record_index",
        "s.stage",
        "s.stage_order",
        "s.status",
        F.when(F.col("s.status") != RUNNING, F.col("created_at")).alias("finished_at"),
        "s.data",
        F.when(F.col("s.status") == RUNNING, F.col("_error")).alias("error"),
        "created_at",
    )


def new_expenses(outcomes: DataFrame) -> DataFrame:
    """K-01/W-05: the rows a run stores, one per id, the last writer."""
    stored = outcomes.where(F.col("outcome") == SUCCESS)
    last = last_per_key(
        stored, "id", [F.col(c).desc() for c in ("process_seq", "batch_index", "record_index")]
    )
    return last.select(
        "id",
        "job_id",
        "empleado_id",
        "fecha",
        F.col("monto_normalizado").alias("monto_original"),
        "moneda_original",
        "categoria",
        "cost_center",
        "fingerprint",
        "negative_amount_detected",
        F.col("base_amount").alias("monto_base"),
        F.col("exchange_rate").alias("tipo_cambio"),
        "validation_status",
        "validation_alerts",
        "created_at",
    )


def upsert_expenses(existing: DataFrame | None, outcomes: DataFrame) -> DataFrame:
    """K-01"""
    new = new_expenses(outcomes)
    return new if existing is None else upsert(existing, new, "id")
