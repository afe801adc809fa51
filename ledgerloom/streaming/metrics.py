"""ST-4: live counters per process."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.constants import DUPLICATE, DUPLICATE_DB, NEGATIVE, PENDIENTE, RECHAZADO, SKIPPED, SUCCESS
from ledgerloom.sources.tables import Files


def finished_epochs(spark: SparkSession, path: str) -> list[int]:
    """Micro-batches whose folder is complete."""
    files = Files(spark, path)
    epochs = [n for n in files.names() if n.startswith("epoch=")]
    return sorted(int(n.removeprefix("epoch=")) for n in epochs if "_SUCCESS" in files.names(n))


def live_metrics(outcomes: DataFrame) -> DataFrame:
    """A-01 over a stream of outcome rows; the state is one row per process."""
    done = F.col("run_status") == SUCCESS
    status = F.coalesce(F.upper("validation_status"), F.lit(PENDIENTE))
    return outcomes.groupBy("process_id").agg(
        F.count_if(done).alias("processed_records"),
        F.count_if(F.col("run_status") == SKIPPED).alias("skipped_records"),
        F.count_if(done & (status == PENDIENTE)).alias("pending_records"),
        F.count_if(done & (status == RECHAZADO)).alias("rejected_records"),
        F.count_if(F.col("outcome") == NEGATIVE).alias("negative_records"),
        F.count_if(F.col("outcome").isin(DUPLICATE, DUPLICATE_DB)).alias("duplicate_records"),
    )


def metrics_stream(
    outcomes: DataFrame,
    path: str,
    checkpoint: str,
    interval: str = "1500 milliseconds",
    available_now: bool = False,
) -> StreamingQuery:
    """Refresh the counters table at ``path``: every micro-batch replaces the version of its epoch."""

    def run(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = (
        live_metrics(outcomes)
        .writeStream.outputMode("complete")
        .foreachBatch(run)
        .option("checkpointLocation", checkpoint)
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of the counters."""
    return spark.read.parquet(f"{path}/epoch={finished_epochs(spark, path)[-1]}")
