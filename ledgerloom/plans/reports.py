"""C-05..C-08: questions about a process and its runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.constants import APROBADO, DUPLICATE, DUPLICATE_DB, PENDIENTE, RECHAZADO, SKIPPED, SUCCESS
from ledgerloom.functions.meta import display_status, effective_status, result_label
from ledgerloom.functions.numbers import js_number
from ledgerloom.operators.paging import newest_first
from ledgerloom.session import stage

Expenses = DataFrame | Callable[[DataFrame], DataFrame]

MAX_AUDIT_ROWS = 500
DEFAULT_REPORT_ROWS = 2000
MAX_REPORT_ROWS = 20000
DEFAULT_PAGE = 50
MAX_PAGE = 200


def clamp(value: int | None, default: int, low: int, high: int) -> int:
    return min(max(value or default, low), high)


# ------------------------------------------------------------------ predicates
def skipped_negative() -> Column:
    """P-04"""
    return (F.col("status") == SKIPPED) & F.col("meta.negative_amount").isNotNull()


def skipped_duplicate() -> Column:
    """P-05"""
    return (F.col("status") == SKIPPED) & F.coalesce(
        F.col("meta.dedup.reason").isin(DUPLICATE, DUPLICATE_DB), F.lit(False)
    )


def filter_runs(
    runs: DataFrame,
    status: str | None = None,
    expense_id: str | None = None,
    process_id: str | None = None,
    validation_status: str | None = None,
) -> DataFrame:
    """P-03/P-06: any combination of filters."""
    if status:
        status = status.lower()
        if status not in ("running", "success", "failed", "skipped"):
            raise ValueError("status inválido (running|success|failed|skipped)")
        runs = runs.where(F.col("status") == status)
    if expense_id:
        runs = runs.where(F.col("expense_id") == expense_id)
    if process_id:
        runs = runs.where(F.col("process_id") == process_id)
    if validation_status:
        runs = runs.where(F.upper("meta.validation.status") == validation_status)
    return runs


# --------------------------------------------------------------------- summary
def with_expense_status(runs: DataFrame, expenses: DataFrame) -> DataFrame:
    """J-01/F-30: runs with the status now in force."""
    states = expenses.where(F.col("job_id").isNotNull()).select(
        "job_id", F.col("validation_status").alias("_expense_status")
    )
    return (
        runs.join(states, "job_id", "left")
        .withColumn("effective_status", effective_status(F.col("_expense_status"), F.col("meta.validation.status")))
        .drop("_expense_status")
    )


def process_metrics(runs: DataFrame, expenses: DataFrame) -> DataFrame:
    """A-01: every counter of every process in one pass.

    Only successful runs can have an expense, so only they take part in the join.
    """
    done = F.col("status") == SUCCESS
    counted = (
        with_expense_status(runs.where(done), expenses)
        .select("process_id", "status", "effective_status")
        .groupBy("process_id")
        .agg(
            F.count("*").alias("processed_records"),
            *[
                F.count_if(F.col("effective_status") == s).alias(f"{name}_records")
                for s, name in ((PENDIENTE, "pending"), (RECHAZADO, "rejected"), (APROBADO, "approved"))
            ],
        )
    )
    other = runs.groupBy("process_id").agg(
        F.count_if(F.col("status") == SKIPPED).alias("skipped_records"),
        F.count_if(skipped_negative()).alias("negative_records"),
        F.count_if(skipped_duplicate()).alias("duplicate_records"),
    )
    names = ["processed_records", "pending_records", "rejected_records", "approved_records"]
    return other.join(counted, "process_id", "left").fillna(0, names)


def process_summary(processes: DataFrame, runs: DataFrame, expenses: DataFrame) -> DataFrame:
    """C-05"""
    metrics = process_metrics(runs, expenses)
    counters = [c for c in metrics.columns if c != "process_id"]
    return processes.join(metrics, "process_id", "left").fillna(0, counters)


def anomaly_summary(runs: DataFrame, examples: int = 3) -> DataFrame:
    """A-03: counts per anomaly and process, with the first ids as examples.

    The examples come from a ranked filter that keeps ``examples`` rows per group
    in each map task.
    """
    kind = F.when(skipped_negative(), F.lit("negative")).when(skipped_duplicate(), F.col("meta.dedup.reason"))
    rows = runs.withColumn("anomaly", kind).where(F.col("anomaly").isNotNull())
    counts = rows.groupBy("process_id", "anomaly").agg(F.count("*").alias("records"))
    order = Window.partitionBy("process_id", "anomaly").orderBy("batch_index", "record_index")
    sample = (
        rows.select("process_id", "anomaly", "expense_id", "batch_index", "record_index")
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= examples)
        .groupBy("process_id", "anomaly")
        .agg(F.array_sort(F.collect_list(F.struct("_rank", "expense_id"))).alias("_found"))
    )
    return counts.join(sample, ["process_id", "anomaly"]).select(
        "process_id",
        "anomaly",
        "records",
        F.array_join(F.col("_found.expense_id"), ",").alias("examples"),
    )


# ----------------------------------------------------------------- audit/report
def _attach_expenses(few_runs: DataFrame, expenses: Expenses, columns: dict[str, str], limit: int) -> DataFrame:
    """Expense columns for at most ``limit`` runs.

    Both broadcast sides hold at most ``limit`` rows: a run stores one expense. ``expenses`` may be a function that finds the
    expenses with the ids of such runs, so that the others need not be read.
    """
    if callable(expenses):
        few_runs = stage(few_runs, "few-runs")
        expenses = expenses(few_runs.select(F.col("expense_id").alias("id")))
    wanted = F.broadcast(few_runs.select("job_id"))
    found = expenses.join(wanted, "job_id", "left_semi").select(
        "job_id", *[F.col(c).alias(a) for c, a in columns.items()]
    )
    return few_runs.join(F.broadcast(found), "job_id", "left")


def process_audit(runs: DataFrame, expenses: Expenses, process_id: str, kind: str) -> DataFrame:
    """C-06/L-02: the newest skipped runs of one kind.  The limit comes before the join."""
    if kind not in ("duplicate", "negative"):
        raise ValueError("kind inválido (duplicate|negative)")
    hit = skipped_negative() if kind == "negative" else skipped_duplicate()
    newest = (
        runs.where((F.col("process_id") == process_id) & hit)
        .select("job_id", "expense_id", "fingerprint", "created_at", "meta")
        .orderBy(F.col("created_at").desc(), "job_id")
        .limit(MAX_AUDIT_ROWS)
    )
    columns = {
        "fecha": "expense_fecha",
        "moneda_original": "expense_moneda_original",
        "monto_original": "expense_monto_original",
        "validation_status": "expense_validation_status",
    }
    return _attach_expenses(newest, expenses, columns, MAX_AUDIT_ROWS).orderBy(
        F.col("created_at").desc(), "job_id"
    )


def process_report(
    runs: DataFrame, expenses: Expenses, process_id: str, max_rows: int | None = None
) -> DataFrame:
    """C-07/L-03/F-31/F-33: the oldest runs of a process as report rows."""
    limit = clamp(max_rows, DEFAULT_REPORT_ROWS, 1, MAX_REPORT_ROWS)
    oldest = (
        runs.where(F.col("process_id") == process_id)
        .select("job_id", "expense_id", "status", "meta", "created_at")
        .orderBy("created_at", "job_id")
        .limit(limit)
    )
    columns = {
        c: f"e_{c}"
        for c in ("id", "fecha", "moneda_original", "monto_original", "categoria", "cost_center", "validation_status")
    }
    blank = F.lit("")
    meta = lambda f: F.col(f"meta.{f}")
    return (
        _attach_expenses(oldest, expenses, columns, limit)
        .orderBy("created_at", "job_id")
        .withColumn("_monto", F.coalesce("e_monto_original", meta("monto_original")))
        .select(
            F.coalesce("e_id", meta("id"), "job_id").alias("id"),
            F.coalesce("e_fecha", meta("fecha"), blank).alias("fecha"),
            F.coalesce("e_moneda_original", meta("moneda_original"), blank).alias("moneda"),
            F.coalesce(js_number("_monto"), blank).alias("monto"),
            F.coalesce("e_categoria", meta("categoria"), blank).alias("categoria"),
            F.coalesce("e_cost_center", meta("cost_center"), blank).alias("cost_center"),
            result_label(
                F.col("status"), F.coalesce("e_validation_status", meta("validation.status"))
            ).alias("resultado"),
        )
    )


# ------------------------------------------------------------------------- jobs
def list_jobs(runs: DataFrame, page: int = 1, page_size: int | None = None, **filters: str) -> DataFrame:
    """C-08/W-06/L-01: newest first."""
    size = clamp(page_size, DEFAULT_PAGE, 1, MAX_PAGE)
    found = newest_first(filter_runs(runs, **filters), (max(page, 1) - 1) * size, size)
    return found.withColumn("display_status", display_status(F.col("status"), F.col("meta.validation.status")))


def page_info(runs: DataFrame, page: int = 1, page_size: int | None = None, **filters: str) -> DataFrame:
    """A-07: a page beyond the end reports the last page."""
    size = clamp(page_size, DEFAULT_PAGE, 1, MAX_PAGE)
    total = filter_runs(runs, **filters).agg(F.count("*").alias("total"))
    pages = F.greatest(F.ceil(F.col("total") / size), F.lit(1)).cast("long")
    return (
        total.withColumn("total_pages", pages)
        .withColumn("page", F.least(F.lit(max(page, 1)).cast("long"), F.col("total_pages")))
        .select(
            "page",
            F.lit(size).alias("page_size"),
            "total",
            "total_pages",
            (F.col("page") < F.col("total_pages")).alias("has_next"),
            (F.col("page") > 1).alias("has_previous"),
        )
    )


def job_detail(runs: DataFrame, stages: DataFrame, fields: Sequence[str] = ("stage", "status", "data")) -> DataFrame:
    """C-08/J-07: each run with its stages, oldest first (at most five).

    ``fields`` of a stage are listed after what orders it; a list moves with all that it holds.
    """
    listed = stages.groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.struct("created_at", "stage_order", *fields))).alias("stages")
    )
    return runs.join(listed, "job_id", "left")


# -------------------------------------------------------------------- processes
def list_processes(processes: DataFrame, limit: int | None = None) -> DataFrame:
    """L-04: newest first."""
    return processes.orderBy(F.col("created_at").desc(), "process_id").limit(clamp(limit, DEFAULT_PAGE, 1, MAX_PAGE))


def process_batches(batches: DataFrame, process_id: str) -> DataFrame:
    """J-08/L-05"""
    return batches.where(F.col("process_id") == process_id).orderBy("batch_index")
