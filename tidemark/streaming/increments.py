"""Progress of a feed that grows, kept up to date at the cost of the new events alone.

Each batch of the feed adds to the three tables of a store (see :mod:`..sources.generations`):

* ``rows``: its stage and task events, by which a doubtful owner can be settled,
* ``jobs``: what it tells of jobs, one row per job,
* ``parts``: sums over its events per stage and job that owned them as far as was known,
  with the first and last time among them.

Sums and job rows of several batches merge into one another, and :func:`compact` does so for
all up to a batch, the high-water mark.

A part belongs to one job if its first and its last event do, by all jobs known when it is
read: parts and listings of a stage meet once, in order of time. Where a job that arrived late
started between the two, the events of that stage are looked at one by one; no others are
counted again. So the result is that of the batch rollups
over the whole feed, in any order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import asof
from tidemark.operators.progress import (
    JOB,
    JOB_CHANGE,
    KINDS,
    LISTED,
    STAGE,
    TASK_END,
    by_crowd,
    coded,
    counters,
    facts_of,
    job_changes,
    job_progress,
    jobs_of_changes,
    merged_changes,
    stage_and_task_events,
    stage_listings,
    stage_state,
)
from tidemark.session import checkpointed
from tidemark.sources import generations
from tidemark.streaming.events import AVAILABLE_NOW

_ROWS = "app_id string, stage_id long, kind string, at long, num_tasks long, task_id long, task_failed boolean"
_SUMS = (
    "num_tasks long, submitted boolean, submitted_at long, tasks_started long, tasks_ended long, "
    "tasks_complete long, complete boolean, tasks_good long"
)
#: Up to so many stages of doubtful owners are broadcast, to read only their events.
FEW_DOUBTFUL = 100_000
_PARTS = f"app_id string, stage_id long, job_id long, {_SUMS}, first long, last long"


def _of_events() -> list[Column]:
    good = (F.col("kind") == KINDS.index(TASK_END)) & ~F.col("task_failed")
    return [*counters(coded=True), F.count_if(good).alias("tasks_good")]


def _of_sums() -> list[Column]:
    flags = [F.bool_or(n).alias(n) for n in ("submitted", "complete")]
    sums = [F.sum(n).alias(n) for n in ("tasks_started", "tasks_ended", "tasks_complete", "tasks_good")]
    return [F.max("num_tasks").alias("num_tasks"), F.min("submitted_at").alias("submitted_at"), *flags, *sums]


def _merged(parts: DataFrame) -> DataFrame:
    spans = [F.min("first").alias("first"), F.max("last").alias("last")]
    return parts.groupBy(*LISTED, "job_id").agg(*_of_sums(), *spans)


def known_jobs(spark: SparkSession, store: str, upto: int | None = None) -> DataFrame:
    """The job facts of all batches so far."""
    return jobs_of_changes(merged_changes(generations.read(spark, f"{store}/jobs", JOB_CHANGE, upto)))


def add_batch(events: DataFrame, store: str, number: int) -> None:
    """Adds the events of one batch; the same number again replaces them."""
    spark = events.sparkSession
    # The logs are read twice: kept in between, they would take more disk than the store.
    generations.write(job_changes(events), f"{store}/jobs", "batch", number)
    generations.write(stage_and_task_events(events), f"{store}/rows", "batch", number)
    rows = coded(spark.read.schema(_ROWS).parquet(f"{store}/rows/batch={number}"))
    # Kept, since they are read twice and take a fraction of their shuffle.
    owners = stage_listings(checkpointed(known_jobs(spark, store, number))).drop("position")
    generations.write(_parts(rows, owners), f"{store}/parts", "batch", number)


def _parts(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """Sums over events per stage and job that owns them, or none."""
    plain, many = by_crowd(rows, owners)
    sums = [*_of_events(), F.min("at").alias("first"), F.max("at").alias("last")]
    along = asof.along(*plain, LISTED, "at", "job_started", "job_id").where(~F.col("_right"))
    owned = along.withColumn("job_id", F.col("_at.tie")).groupBy(*LISTED, "job_id").agg(*sums)
    busy = asof.asof_join(*many, LISTED, "at", "job_started", "job_id", how="left")
    return owned.unionByName(busy.groupBy(*LISTED, "job_id").agg(*sums))


def compact(spark: SparkSession, store: str, upto: int) -> None:
    """Merges the sums and jobs of all batches up to one into a generation."""
    changes = generations.read(spark, f"{store}/jobs", JOB_CHANGE, upto)
    parts = generations.read(spark, f"{store}/parts", _PARTS, upto)
    for rows, table in ((merged_changes(changes), "jobs"), (_merged(parts), "parts")):
        generations.write(rows, f"{store}/{table}", "gen", upto)
        generations.forget(spark, f"{store}/{table}", upto)


def track(events: DataFrame, store: str, checkpoint: str, every: int = 50, trigger=AVAILABLE_NOW) -> StreamingQuery:
    """Adds each batch of a feed to the store, and compacts it after ``every`` batches."""

    def add(batch: DataFrame, number: int) -> None:
        add_batch(batch, store, number)
        if number % every == every - 1:
            compact(batch.sparkSession, store, number)

    writer = events.writeStream.option("checkpointLocation", checkpoint)
    return writer.foreachBatch(add).trigger(**trigger).start()


def _states(spark: SparkSession, store: str, owners: DataFrame) -> DataFrame:
    """The sums per listing, null where it owns no events."""
    parts = generations.read(spark, f"{store}/parts", _PARTS).drop("job_id")
    both = asof.in_order(asof.together(parts, owners, LISTED, "first", "job_started"), LISTED, "job_id")
    is_start = F.col("_right") & F.col("_time").isNotNull()
    later = Window.partitionBy(*LISTED).orderBy(F.col("_time").desc(), "_right").rowsBetween(Window.unboundedPreceding, -1)
    next_start = F.last(F.when(is_start, F.col("_time")), ignorenulls=True).over(later)
    # A part with no stage is of nobody.
    split = ~F.col("_right") & F.coalesce(next_start <= F.col("last"), F.lit(False))
    stage = Window.partitionBy(*LISTED)
    marked = both.withColumn("_split", split).withColumn("doubtful", F.max("_split").over(stage))
    job = F.when(F.col("_right"), F.col("job_id")).otherwise(F.col("_at.tie"))
    owned = marked.withColumn("job_id", job).where(F.col("_right") | F.col("job_id").isNotNull())
    started = F.max(F.when(F.col("_right"), F.col("_time"))).alias("job_started")
    kept = checkpointed(owned.groupBy(*STAGE, "doubtful").agg(*_of_sums(), started))
    doubtful = kept.where("doubtful").select(*JOB, "stage_id", "job_started")
    clear = kept.where("NOT doubtful").drop("doubtful", "job_started")
    few = doubtful.limit(FEW_DOUBTFUL + 1).count()
    if not few:
        return clear
    rows = coded(generations.read(spark, f"{store}/rows", _ROWS))
    if few <= FEW_DOUBTFUL:
        rows = rows.join(F.broadcast(doubtful.select(*LISTED)), LISTED, "left_semi")
    return clear.unionByName(stage_state(rows, doubtful, _of_events()))


def tracked_facts(spark: SparkSession, store: str, failed_count: bool = True) -> tuple[DataFrame, DataFrame]:
    """Job and stage facts of all batches so far, as of the batch rollups over the whole feed."""
    jobs = checkpointed(known_jobs(spark, store))
    state = _states(spark, store, stage_listings(jobs).drop("position"))
    if not failed_count:
        state = state.withColumn("tasks_complete", F.col("tasks_good"))
    return jobs, facts_of(state)


def tracked_progress(spark: SparkSession, store: str) -> DataFrame:
    return job_progress(*tracked_facts(spark, store))
