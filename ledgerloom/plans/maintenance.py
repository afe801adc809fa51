"""C-09 and C-10: deletions, as new versions of the stored tables.

Every function returns DataFrames; write them to a new place and swap, never over
the tables they were read from.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tables:
    runs: DataFrame
    stages: DataFrame
    expenses: DataFrame
    batches: DataFrame | None = None
    processes: DataFrame | None = None


def detach(expenses: DataFrame, jobs: DataFrame) -> DataFrame:
    """Expenses of ``jobs`` stay but lose their ``job_id``."""
    held, free = _by_job(expenses)
    marked = jobs.select("job_id").distinct().withColumn("_gone", F.lit(True))
    return (
        held.join(marked, "job_id", "left")
        .withColumn("job_id", F.when(F.col("_gone").isNull(), F.col("job_id")))
        .select(*expenses.columns)
        .unionByName(free)
    )


def _by_job(expenses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Expenses with a run and those without: the latter may be most, and would all join on one null key."""
    return expenses.where(F.col("job_id").isNotNull()), expenses.where(F.col("job_id").isNull())


def delete_jobs(tables: Tables, jobs: DataFrame) -> tuple[Tables, DataFrame]:
    """C-09/J-09/A-09: (tables without the runs, one-row count of the removed runs)."""
    keys = jobs.select("job_id").distinct()
    removed = tables.runs.join(keys, "job_id", "left_semi").agg(F.count("*").alias("deleted"))
    return (
        Tables(
            runs=tables.runs.join(keys, "job_id", "left_anti"),
            stages=tables.stages.join(keys, "job_id", "left_anti"),
            expenses=detach(tables.expenses, keys),
            batches=tables.batches,
            processes=tables.processes,
        ),
        removed,
    )


def batch_ids(batches: DataFrame) -> DataFrame:
    """N-03/A-08: the distinct expense ids named by batches."""
    return batches.select(F.explode("expense_ids").alias("id")).where(F.col("id") != "").distinct()


def delete_process(
    tables: Tables, process_id: str, hard: bool = False, strict_scope: bool = False
) -> Tables:
    """C-10: forget a process.

    Soft detaches its expenses.  Hard removes them, and every expense whose id one
    of its batches names, even when another process stored it; ``strict_scope``
    limits that to the process's own runs.  Dedup keys derive from the runs, so
    nothing else is left.
    """
    mine = F.col("process_id") == process_id
    jobs = tables.runs.where(mine).select("job_id")
    if not hard:
        expenses = detach(tables.expenses, jobs)
    else:
        held, free = _by_job(tables.expenses)
        expenses = held.join(jobs, "job_id", "left_anti").select(*tables.expenses.columns).unionByName(free)
        if not strict_scope:
            expenses = expenses.join(batch_ids(tables.batches.where(mine)), "id", "left_anti")
        expenses = expenses.select(*tables.expenses.columns)
    return Tables(
        runs=tables.runs.where(~mine),
        stages=tables.stages.where(~mine),
        expenses=expenses,
        batches=tables.batches.where(~mine),
        processes=tables.processes.where(~mine),
    )
