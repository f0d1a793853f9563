"""Streaming jobs over an event feed.

Each function starts a query with the given trigger, ``availableNow`` by default, and
returns it; the checkpoint makes a restarted query go on where it stopped.

The main path is :func:`ingest`: an exactly-once copy of the feed as parquet, over
which the batch rollups run in parallel by job. They also recover events that arrive
before the start of their job or stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.progress import (
    STAGE_COMPLETED,
    STAGE_SUBMITTED,
    TASK_END,
    TASK_START,
    facts_from_events,
    job_progress,
    stage_and_task_events,
)
from tidemark.sources import generations

AVAILABLE_NOW = {"availableNow": True}
_BATCH = "_batch"


def ingest(events: DataFrame, out: str, checkpoint: str, trigger=AVAILABLE_NOW) -> StreamingQuery:
    """Appends the feed to parquet files, each event exactly once, a folder per kind."""
    writer = events.writeStream.format("parquet").option("compression", "zstd").option("checkpointLocation", checkpoint)
    return writer.partitionBy("Event").outputMode("append").trigger(**trigger).start(out)


def progress_of_feed(spark: SparkSession, path: str, keep: int | None = None) -> DataFrame:
    """Progress of all jobs in an ingested feed, or of the retained ones."""
    return job_progress(*facts_from_events(spark.read.parquet(path), keep))


def event_counts(
    events: DataFrame, out: str, checkpoint: str, kind: str = "Event", trigger=AVAILABLE_NOW
) -> StreamingQuery:
    """Running number of events of each kind; see :func:`latest_result`."""
    counts = events.groupBy(kind).agg(F.count(F.lit(1)).alias("total"))

    def write(batch: DataFrame, number: int) -> None:
        # A whole result each time, of which the one before stays for its readers.
        generations.write(batch, out, "gen", number)
        generations.forget(batch.sparkSession, out, number)

    return _start(counts, "complete", write, checkpoint, trigger)


def stage_states(
    events: DataFrame, out: str, checkpoint: str, every: int = 20, trigger=AVAILABLE_NOW
) -> StreamingQuery:
    """Running state of each stage; see :func:`latest_rows`.

    A batch writes the stages that it changed; after ``every`` batches they are merged into
    one generation, so that the folders and rows kept are bounded.

    Keyed by application and stage, so one busy application spreads over all tasks and
    the state of a stage is one row of counters. Which job owns the stage is left to
    the batch rollups.
    """
    kind = F.col("kind")
    state = (
        stage_and_task_events(events)
        .groupBy("app_id", "stage_id")
        .agg(
            F.max("num_tasks").alias("num_tasks"),
            F.bool_or(kind == STAGE_SUBMITTED).alias("submitted"),
            F.count_if(kind == TASK_START).alias("tasks_started"),
            F.count_if(kind == TASK_END).alias("tasks_complete"),
            F.bool_or(kind == STAGE_COMPLETED).alias("complete"),
        )
    )

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        generations.write(batch.withColumn(_BATCH, F.lit(number)), out, "batch", number)
        if number % every == every - 1:
            rows = spark.read.parquet(*generations.current(spark, out, number))
            generations.write(_newest(rows, ["app_id", "stage_id"]), out, "gen", number)
            generations.forget(spark, out, number)

    return _start(state, "update", write, checkpoint, trigger)


def _start(rows: DataFrame, mode: str, write, checkpoint: str, trigger) -> StreamingQuery:
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.foreachBatch(write).trigger(**trigger).start()


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    payload = F.struct(*[F.col(name) for name in rows.columns if name not in keys])
    newest = rows.groupBy(*keys).agg(F.max_by(payload, F.col(_BATCH)).alias("_row"))
    return newest.select(*keys, "_row.*")


def latest_result(spark: SparkSession, out: str) -> DataFrame:
    """The rows of the last batch, for a query that writes its whole result each time."""
    return spark.read.parquet(*generations.current(spark, out))


def latest_rows(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The last version of each key, for a query that writes only changed rows."""
    return _newest(spark.read.parquet(*generations.current(spark, out)), keys).drop(_BATCH)
