"""K-01, C-09, C-10 on the stored tables: commits that touch only the file groups with rows to change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.audit import job_runs, job_stages, new_expenses
from ledgerloom.plans.maintenance import batch_ids
from ledgerloom.plans.reports import process_audit, process_report
from ledgerloom.session import stage, staging
from ledgerloom.sources.tables import Commit, Store


def store_outcomes(commit: Commit, outcomes: DataFrame, policy=None) -> None:
    """K-01..K-03 for the outcome rows of one run: expenses replaced by id, runs and stages added.

    ``outcomes`` should be stored rows that lie by process: they are read several times, and runs and stages (up to five
    a run, each as wide as its outcome) are written from where they are.
    """
    fresh = stage(new_expenses(outcomes), "new-expenses")
    commit.amend("expenses", fresh, "id", add=fresh)
    commit.append("job_runs", job_runs(outcomes, policy), dealt=True)
    commit.append("job_run_stages", job_stages(outcomes), dealt=True)


def save_tables(commit: Commit, **tables: DataFrame) -> None:
    """Write whole tables, by name."""
    for name, df in tables.items():
        commit.replace(name, df)


def audit(store: Store, process_id: str, kind: str) -> DataFrame:
    """C-06 on the stored tables: the runs of one process, and of the expenses those that its page names."""
    return process_audit(store.read("job_runs", [process_id]), expenses_by_id(store), process_id, kind)


def report(store: Store, process_id: str, max_rows: int | None = None) -> DataFrame:
    """C-07 on the stored tables."""
    return process_report(store.read("job_runs", [process_id]), expenses_by_id(store), process_id, max_rows)


def expenses_by_id(store: Store):
    """Finds stored expenses by their ids."""
    return lambda ids: store.lookup("expenses", "id", ids.distinct())


def _loosen(commit: Commit, jobs: DataFrame, ids: DataFrame) -> None:
    """Expenses of ``jobs`` stay but lose their run; ``ids`` are the expenses that these runs named."""
    gone = jobs.select("job_id").distinct().withColumn("_gone", F.lit(True))
    near = commit.store.touched("expenses", ids)
    held = commit.read("expenses", near).join(gone, "job_id", "left_semi").select("id")

    def free(rows: DataFrame) -> DataFrame:
        return rows.withColumn("job_id", F.lit(None).cast("string"))

    commit.amend("expenses", stage(held, "loose-expenses"), "id", change=free)


def delete_jobs(store: Store, jobs: DataFrame) -> int:
    """C-09/J-09/A-09: remove runs (``job_id``, ``process_id``) and their stages, detach their expenses; how many runs there were.

    Files of processes without one of the runs, and of expenses that none of them stored, stay as they are.
    """
    with staging(store.spark), store.commit() as c:
        keys = stage(jobs.select("job_id", "process_id").distinct(), "deleted-jobs")
        processes = [r[0] for r in keys.select("process_id").distinct().collect()]
        runs = c.read("job_runs", processes)
        doomed = stage(runs.join(keys.select("job_id"), "job_id", "left_semi").select("job_id", F.col("expense_id").alias("id")), "deleted-runs")
        _loosen(c, doomed, doomed)
        for name in ("job_runs", "job_run_stages"):
            c.replace(name, c.read(name, processes).join(keys.select("job_id"), "job_id", "left_anti"), processes)
        return doomed.count()


def delete_process(store: Store, process_id: str, hard: bool = False, strict_scope: bool = False) -> None:
    """C-10: forget a process; see ``maintenance.delete_process``. Its runs, stages and batches are dropped without reading other files."""
    with staging(store.spark), store.commit() as c:
        runs = stage(c.read("job_runs", [process_id]).where(F.col("process_id") == process_id).select("job_id", F.col("expense_id").alias("id")), "process-runs")
        if not hard:
            _loosen(c, runs, runs)
        else:
            near = c.store.touched("expenses", runs)
            doomed = c.read("expenses", near).join(runs.select("job_id"), "job_id", "left_semi").select("id")
            if not strict_scope:
                doomed = doomed.unionByName(batch_ids(c.read("file_process_batches", [process_id]).where(F.col("process_id") == process_id)))
            c.amend("expenses", stage(doomed, "process-expenses"), "id")
        for name in ("job_runs", "job_run_stages", "file_process_batches"):
            c.drop(name, [process_id])
        one = store.spark.range(1).select(F.lit(process_id).alias("process_id"))
        c.amend("file_processes", one, "process_id")
