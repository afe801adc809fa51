"""The stored tables of one sample folder, written on first use.

Ingestion and the record plan run once per Spark application and folder, as they
do before anyone asks questions about a process; the questions then read tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.constants import COMPLETADO, STANDARD_POLICY, STATIC_RATES
from ledgerloom.operators.mapping import LINEAGE, map_columns, valid
from ledgerloom.operators.numbering import number_in_order
from ledgerloom.plans.audit import job_runs, job_stages, new_expenses
from ledgerloom.plans.ingest import file_batches, file_totals, to_batches
from ledgerloom.plans.outcomes import packed, run_records, unpacked
from ledgerloom.plans.stored import save_tables
from ledgerloom.session import CODEC, new_path, released_shuffles, stage, staging, unsorted_groups
from ledgerloom.sources import bridge
from ledgerloom.sources.tables import Store

AS_OF = date(2001, 1, 1)
# one currency has no rate, so that some runs fail
RATES = {c: r for c, r in STATIC_RATES.items() if c != "EUR"}
EPOCH = 978307200  # 2001-01-01T00:00:00Z

_spaces: dict[tuple[str, str], "Workspace"] = {}


def workspace(spark: SparkSession, sf_dir: str) -> "Workspace":
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _spaces:
        _spaces[key] = Workspace(spark, sf_dir)
    return _spaces[key]


class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def ingest(self) -> DataFrame:
        """Raw records with batch, position and arrival time, numbered anew."""
        return self.texts(self.number())

    def number(self) -> DataFrame:
        """The values of the records in their order. Texts are made of them afterwards, so these do not travel."""
        return number_in_order(bridge.lines(self.spark, self.sf_dir), "process_seq", bridge.ORDER)

    @staticmethod
    def texts(numbered: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        texts = bridge.texts(numbered, keep=["seq", *keep])
        return to_batches(texts, bridge.BATCH_SIZE).withColumn(
            "created_at", F.timestamp_seconds(F.lit(EPOCH) + F.col("seq"))
        )

    @cached_property
    def numbered(self) -> DataFrame:
        return self.number()

    @cached_property
    def records(self) -> DataFrame:
        return self.texts(self.numbered)

    @property
    def columns(self) -> list[str]:
        return [*bridge.COLUMNS, *bridge.EXTRA]

    @property
    def expenses_in(self) -> DataFrame:
        """Canonical, valid expenses."""
        return valid(map_columns(self.records, self.columns))

    def run(self) -> DataFrame:
        return run_records(bridge.needed(self.numbered), STANDARD_POLICY, RATES, AS_OF, parse=self.parse)

    def parse(self, numbered: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Canonical, valid expenses of numbered rows."""
        return valid(map_columns(self.texts(numbered, keep), self.columns, keep=[c for c in keep if c not in LINEAGE]))

    @cached_property
    def outcomes_path(self) -> str:
        """The packed outcome rows by process.

        They are written from where the record plan leaves them, as there are few processes here: a task has a file for each.
        """
        path = new_path(self.spark, "outcomes")
        _ = self.numbered  # stays, what else is stored on the way does not
        with staging(self.spark), unsorted_groups(self.spark), released_shuffles(self.spark):
            packed(self.run()).write.option("compression", CODEC).partitionBy("process_id").parquet(path)
        return path

    @cached_property
    def stored_outcomes(self) -> DataFrame:
        return self.spark.read.parquet(self.outcomes_path)

    @property
    def outcomes(self) -> DataFrame:
        return unpacked(self.stored_outcomes)

    @property
    def runs(self) -> DataFrame:
        return job_runs(self.outcomes, STANDARD_POLICY)

    @property
    def stages(self) -> DataFrame:
        return job_stages(self.outcomes)

    @cached_property
    def expenses(self) -> DataFrame:
        return stage(new_expenses(self.outcomes), "expenses")

    @cached_property
    def batches(self) -> DataFrame:
        return stage(file_batches(self.records, self.columns), "batches")

    @cached_property
    def processes(self) -> DataFrame:
        totals = file_totals(self.records)
        seq = F.substring("process_id", 2, 9).cast("int")
        return stage(
            totals.select(
                "process_id",
                F.concat("process_id", F.lit(".csv")).alias("filename"),
                F.concat(F.lit("file:///uploads/"), "process_id", F.lit(".csv")).alias("storage_uri"),
                F.lit(COMPLETADO).alias("status"),
                "total_records",
                "published_batches",
                F.timestamp_seconds(F.lit(EPOCH) + seq * 60).alias("created_at"),
            ),
            "processes",
        )

    @cached_property
    def tables(self) -> Store:
        """The tables as a store, to be read only."""
        store = Store(self.spark, new_path(self.spark, "store"))
        with store.commit() as c:
            save_tables(c, expenses=self.expenses, file_process_batches=self.batches, file_processes=self.processes)
            # the outcomes lie by process already
            c.replace("job_runs", self.runs, dealt=True)
            c.replace("job_run_stages", self.stages, dealt=True)
        return store

    def store(self) -> Store:
        """The tables as a store that the caller may change: it starts from the same files."""
        return self.tables.clone(new_path(self.spark, "store"))
