"""C-03: from a source file to numbered raw records and file metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.constants import COMPLETADO, ERROR, PROCESANDO
from ledgerloom.operators.lookup import dimension_join
from ledgerloom.operators.mapping import batch_expense_id, map_columns, valid
from ledgerloom.operators.numbering import batch_columns, number_pieces, running_sum
from ledgerloom.sources.files import CORRUPT, read_expense_csv
from ledgerloom.session import stage
from ledgerloom.sources.tables import Store


@dataclass(frozen=True)
class Ingested:
    records: DataFrame
    batches: DataFrame
    processes: DataFrame
    columns: list[str]


def to_batches(numbered: DataFrame, batch_size: int) -> DataFrame:
    """W-01 on rows that carry their dense position in ``seq``."""
    return numbered.withColumns(batch_columns(F.col("seq"), batch_size))


def file_batches(records: DataFrame, columns: list[str]) -> DataFrame:
    """A-04/K-04: count and ordered expense ids per batch.

    A group is one batch, so a list never exceeds the batch size.
    """
    item = F.struct("record_index", batch_expense_id(columns).alias("id"))
    return (
        records.groupBy("process_id", "batch_index")
        .agg(F.count("*").cast("int").alias("record_count"), F.sort_array(F.collect_list(item)).alias("_items"))
        .select(
            "process_id",
            "batch_index",
            "record_count",
            F.array_compact(F.col("_items.id")).alias("expense_ids"),
        )
    )


def file_totals(records: DataFrame) -> DataFrame:
    """A-05"""
    return records.groupBy("process_id").agg(
        F.count("*").alias("total_records"), F.max("batch_index").alias("published_batches")
    )


def progress(batches: DataFrame) -> DataFrame:
    """A-06: totals after each batch."""
    return running_sum(batches, "process_id", "batch_index", ["record_count"]).select(
        "process_id",
        "batch_index",
        F.col("running_record_count").alias("total_records"),
        F.col("batch_index").alias("published_batches"),
    )


def ingest_files(
    spark: SparkSession, path: str, batch_size: int, strict: bool = True, multi_line: bool = True, after: int = 0
) -> Ingested:
    """C-03: read the CSV files under ``path``; each file is one process.

    The parsed rows are stored once with their split and position, then numbered
    per file in file order.  A file with a malformed row becomes ERROR as a whole,
    or with ``strict=False`` just loses that row.  Processes follow each other by the time
    their files were written, then by path; ``process_seq`` counts them from ``after`` on.
    """
    raw, columns = read_expense_csv(spark, path, multi_line=multi_line)
    landed = stage(
        raw.withColumns(
            {
                "process_id": F.sha2(F.col("_file.file_path"), 256),
                "filename": F.col("_file.file_name"),
                "storage_uri": F.col("_file.file_path"),
                "created_at": F.col("_file.file_modification_time"),
                "_block": F.col("_file.file_block_start"),
                "_local": F.monotonically_increasing_id(),
            }
        ).drop("_file"),
        "landed",
    )
    damage = landed.groupBy("process_id", "filename", "storage_uri", "created_at").agg(
        F.count("*").alias("_lines"), F.count(CORRUPT).alias("_bad")
    )
    # one row per file
    order = Window.orderBy("created_at", "storage_uri")
    damage = stage(damage.withColumn("process_seq", (F.row_number().over(order) + after - 1).cast("int")), "processes")
    if strict:
        broken = damage.where(F.col("_bad") > 0).select("process_id")
        good = dimension_join(landed, broken, ["process_id"], [F.col("_local")], "left_anti")
    else:
        # dropped rows leave gaps; a piece is one input split, so its window is bounded
        piece = Window.partitionBy("process_id", "_block").orderBy("_local")
        good = landed.where(F.col(CORRUPT).isNull()).withColumn("_local", F.row_number().over(piece))
    numbered = number_pieces(good, "process_id", ["_block"], "_local", "seq")
    turns = damage.select("process_id", "process_seq")
    numbered = dimension_join(numbered, turns, ["process_id"], [F.col("seq")])
    records = to_batches(numbered.drop(CORRUPT, "storage_uri"), batch_size)
    totals = file_totals(records)
    failed = (F.col("_bad") > 0) & F.lit(strict)
    processes = damage.join(totals, "process_id", "left").select(
        "process_id",
        "process_seq",
        "filename",
        "storage_uri",
        F.when(failed, F.lit(ERROR)).otherwise(F.lit(COMPLETADO)).alias("status"),
        F.coalesce("total_records", F.lit(0)).alias("total_records"),
        F.coalesce("published_batches", F.lit(0)).alias("published_batches"),
        F.when(failed, F.concat(F.col("_bad").cast("string"), F.lit(" filas inválidas"))).alias("error_message"),
        "created_at",
    )
    return Ingested(records, file_batches(records, columns), processes, columns)


def started(done: Ingested) -> DataFrame:
    """K-05: the process rows while their files are being read."""
    return done.processes.withColumns(
        {
            "status": F.lit(PROCESANDO),
            "total_records": F.lit(0).cast("long"),
            "published_batches": F.lit(0),
            "error_message": F.lit(None).cast("string"),
        }
    )


def ingested_expenses(done: Ingested) -> DataFrame:
    """C-04's input: the canonical valid expenses of the files."""
    return valid(map_columns(done.records, done.columns, blank=False))


def ingest_into(store: Store, path: str, batch_size: int, strict: bool = True) -> DataFrame:
    """C-03 with K-04 and K-05: store the processes as PROCESANDO, then their batches and their end together.

    Returns the canonical expenses, ready for ``run_records``.  Files of other processes' batches stay as they
    are; a file that is read again replaces its own rows. One id per file comes to the driver, as the listing of the files does.
    """
    known = store.read("file_processes") if store.exists("file_processes") else None
    after = 0 if known is None else known.agg(F.max("process_seq") + 1).first()[0] or 0
    done = ingest_files(store.spark, path, batch_size, strict, after=after)
    mine = stage(done.processes.select("process_id"), "ingested-processes")
    with store.commit() as c:
        c.amend("file_processes", mine, "process_id", add=started(done))
    with store.commit() as c:
        c.replace("file_process_batches", done.batches, [r[0] for r in mine.collect()])
        c.amend("file_processes", mine, "process_id", add=done.processes)
    return ingested_expenses(done)
