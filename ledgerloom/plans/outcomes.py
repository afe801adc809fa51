"""C-04: one wide row per record, from canonical expense to outcome.

Everything that depends on a single row is a projection.  The rows are shuffled
once, for the duplicate verdicts; rates and policies join without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.constants import (
    DUPLICATE,
    DUPLICATE_DB,
    FAILED,
    FINGERPRINT_FIELDS,
    NEGATIVE,
    SKIPPED,
    SUCCESS,
)
from ledgerloom.functions.identity import fingerprint, job_id
from ledgerloom.functions.numbers import round_base
from ledgerloom.operators.contract import contract_errors, contract_ok
from ledgerloom.operators.dedup import mark_duplicates
from ledgerloom.operators.fx import NO_RATE, attach_rate, effective_rate
from ledgerloom.operators.lookup import HOT_ROWS
from ledgerloom.operators.policy import base_currency, literal_policy
from ledgerloom.operators.rules import STANDARD_RULES, Rule, evaluate
from ledgerloom.schemas import ALERTS
from ledgerloom.session import stage


def with_fingerprint(expenses: DataFrame, fields: Sequence[str] = FINGERPRINT_FIELDS) -> DataFrame:
    return expenses.withColumn("fingerprint", fingerprint(fields))


def normalize_amount(expenses: DataFrame) -> DataFrame:
    """F-12"""
    return expenses.withColumns(
        {
            "negative_amount_detected": F.col("monto_original") < 0,
            "monto_normalizado": F.abs("monto_original"),
        }
    )


def price(
    expenses: DataFrame,
    rates: Mapping[str, float] | DataFrame,
    policy_base: str | None,
    default_base: str | None = None,
) -> DataFrame:
    """F-13..F-17: add base_currency, base_amount, exchange_rate and rate_source.

    A supplied base amount needs no rate; a supplied rate is only recorded.
    """
    text = lambda v: F.lit(v).cast("string")
    base = base_currency(text(policy_base), text(default_base), F.col("moneda_original"))
    priced = attach_rate(
        expenses.withColumn("base_currency", base),
        rates,
        F.col("moneda_original"),
        F.col("base_currency"),
        F.col("fecha"),
    )
    supplied = F.col("monto_base").isNotNull()
    amount = F.coalesce("monto_base", F.col("monto_normalizado") * F.col("rate"))
    priced = priced.withColumn("_exact", amount).withColumn(
        "base_amount", round_base(F.col("_exact"), F.col("base_currency"))
    )
    return priced.withColumns(
        {
            "exchange_rate": effective_rate(
                F.col("tipo_cambio"),
                F.when(~supplied, F.col("rate")),
                F.col("base_amount"),
                F.col("monto_normalizado"),
            ),
            "rate_source": F.when(~supplied, F.col("rate_source")),
        }
    ).drop("rate", "_exact")


def _failed_stage() -> Column:
    """Where a row that gets past dedup and sign fails; null when it does not."""
    return F.when(F.col("base_amount").isNull(), F.lit("currency")).when(
        ~contract_ok(F.col("monto_normalizado"), F.col("base_amount")), F.lit("validation")
    )


def _reason() -> Column:
    pair = F.concat_ws("-", F.upper("moneda_original"), F.col("base_currency"))
    clauses = contract_errors(F.col("monto_normalizado"), F.col("base_amount"))
    return F.when(F.col("failed_stage") == "currency", F.concat(F.lit(f"{NO_RATE}: "), pair)).when(
        F.col("failed_stage") == "validation", F.array_join(clauses, ". ")
    )


def assess(
    expenses: DataFrame,
    policy: Mapping,
    rates: Mapping[str, float] | DataFrame,
    default_base: str | None = None,
) -> DataFrame:
    """Sign, price and contract of every row, before and apart from duplicates."""
    priced = price(normalize_amount(expenses), rates, policy.get("moneda_base"), default_base)
    return priced.withColumn("failed_stage", _failed_stage())


def packed(outcomes: DataFrame) -> DataFrame:
    """Outcome rows to be moved or stored: digits as bytes, and without the id that the position gives."""
    return outcomes.drop("job_id").withColumn("fingerprint", F.unhex("fingerprint"))


def unpacked(rows: DataFrame) -> DataFrame:
    ids = job_id(F.col("process_id"), F.col("batch_index"), F.col("record_index"))
    return rows.withColumns({"fingerprint": F.lower(F.hex("fingerprint")), "job_id": ids})


def _as_bytes(known: DataFrame | None) -> DataFrame | None:
    """Fingerprints of earlier runs as bytes; a text that is no fingerprint meets none."""
    if known is None:
        return None
    code = F.unhex("fingerprint")
    return known.where(F.lower(F.hex(code)) == F.col("fingerprint")).withColumn("fingerprint", code)


def run_records(
    expenses: DataFrame,
    policy: Mapping,
    rates: Mapping[str, float] | DataFrame,
    as_of: datetime | date | None = None,
    tz: str = "UTC",
    persisted: DataFrame | None = None,
    seen: DataFrame | None = None,
    in_sequence: bool = True,
    fields: Sequence[str] = FINGERPRINT_FIELDS,
    rules: Sequence[Rule] = STANDARD_RULES,
    default_base: str | None = None,
    hot_rows: int = HOT_ROWS,
    store_parsed: bool = True,
    parse: Callable[[DataFrame, Sequence[str]], DataFrame] | None = None,
) -> DataFrame:
    """C-04/N-01: the outcome of every valid record.

    Order of exits as in a run: duplicate, negative, failed, success.  The plan passes
    over the records twice; with ``store_parsed`` they are parsed once, into a columnar table of which the
    first pass reads a few columns. Fingerprints are taken anew in each pass, and travel as 32 bytes instead of 64 digits.

    With ``parse``, ``expenses`` are stored raw rows, narrower than what is made of them, and ``parse(rows, keep)`` gives the
    valid records of them, with the columns ``keep``; raw names differ from canonical ones but for positions. Raw rows
    travel then, and are parsed before and after.
    """
    raw: Sequence[str] = expenses.columns
    if parse is not None:
        expenses = parse(expenses, raw)
    elif store_parsed:
        expenses = stage(expenses, "parsed")
    marked = with_fingerprint(expenses, fields).withColumn("fingerprint", F.unhex("fingerprint"))
    persisted, seen = (_as_bytes(known) for known in (persisted, seen))
    storable = assess(marked, policy, rates, default_base).withColumn(
        "persistable", ~F.col("negative_amount_detected") & F.col("failed_stage").isNull()
    )
    if parse is None:
        verdicts = mark_duplicates(marked, storable, persisted, seen, in_sequence, hot_rows)
    else:
        narrow = marked.select(*dict.fromkeys([*raw, "process_id", "process_seq", "batch_index", "record_index", "fingerprint"]))
        verdicts = parse(mark_duplicates(narrow, storable, persisted, seen, in_sequence, hot_rows), ["fingerprint", "duplicate"])
    view = literal_policy(policy)
    stored = F.col("duplicate").isNull() & ~F.col("negative_amount_detected") & F.col("failed_stage").isNull()
    judged = evaluate(
        assess(verdicts, policy, rates, default_base), view, as_of, tz, rules, amount=F.col("base_amount"), told=stored
    )
    outcome = (
        F.when(F.col("duplicate").isNotNull(), F.col("duplicate"))
        .when(F.col("negative_amount_detected"), F.lit(NEGATIVE))
        .when(F.col("failed_stage").isNotNull(), F.lit(FAILED))
        .otherwise(F.lit(SUCCESS))
    )
    done = judged.drop("error", "dias", "monto_convertido").withColumn("outcome", outcome)
    ok = F.col("outcome") == SUCCESS
    priced = F.col("outcome").isin(SUCCESS, FAILED)
    failed = F.col("outcome") == FAILED
    created = F.col("created_at") if "created_at" in expenses.columns else F.current_timestamp()
    return done.select(
        "process_id",
        "process_seq",
        "batch_index",
        "record_index",
        job_id(F.col("process_id"), F.col("batch_index"), F.col("record_index")).alias("job_id"),
        created.alias("created_at"),
        "id",
        "empleado_id",
        "fecha",
        "monto_original",
        "moneda_original",
        "categoria",
        "cost_center",
        "monto_base",
        "tipo_cambio",
        "csv_row",
        F.lower(F.hex("fingerprint")).alias("fingerprint"),
        "outcome",
        F.when(F.col("outcome").isin(DUPLICATE, DUPLICATE_DB, NEGATIVE), F.lit(SKIPPED))
        .when(failed, F.lit(FAILED))
        .otherwise(F.lit(SUCCESS))
        .alias("run_status"),
        "negative_amount_detected",
        "monto_normalizado",
        F.when(priced, F.col("base_amount")).alias("base_amount"),
        F.when(priced, F.col("exchange_rate")).alias("exchange_rate"),
        F.when(priced, F.col("rate_source")).alias("rate_source"),
        F.when(ok, F.col("status")).alias("validation_status"),
        F.when(ok, F.col("alertas")).otherwise(F.lit(None).cast(ALERTS)).alias("validation_alerts"),
        F.when(failed, F.col("failed_stage")).alias("failed_stage"),
        F.when(failed, _reason()).alias("error"),
    )
