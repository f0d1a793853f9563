"""Streams over stages that let go of their state: closed stages, and owners of early events.

Both use the times in the events. A watermark trails the latest one by ``delay``; what is
older when it arrives may be left out, and what can no longer change leaves the state store.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.progress import (
    JOB_START,
    LISTED,
    STAGE,
    STAGE_COMPLETED,
    STAGE_SUBMITTED,
    TASK_END,
    TASK_START,
    of_kind,
    stage_and_task_events,
)
from tidemark.sources import generations
from tidemark.streaming.events import AVAILABLE_NOW

_SUMS = ["tasks_started", "tasks_complete", "tasks_failed"]
_TOPS = ["num_tasks", "submitted", "complete", "last_event", "ended_at"]
_PARTIAL = "app_id string, stage_id long, " + ", ".join(f"{n} long" for n in [*_SUMS, *_TOPS])


def happened(events_of_stages: DataFrame) -> DataFrame:
    """Adds the time of each event itself, in milliseconds."""
    info, task, kind = F.col("`Stage Info`"), F.col("`Task Info`"), F.col("Event")
    end = F.when(kind == STAGE_COMPLETED, info["Completion Time"]).when(kind == TASK_END, task["Finish Time"])
    start = F.coalesce(info["Submission Time"], task["Launch Time"])
    return events_of_stages.withColumn("happened", F.coalesce(end, start))


# Stages that have ended


def _partials(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counters per stage of each Arrow batch, so that a busy stage is shuffled as few rows."""
    for frame in frames:
        kind, when = frame["kind"], frame["happened"]
        ends = kind == TASK_END
        parts = pd.DataFrame(
            {
                "app_id": frame["app_id"],
                "stage_id": frame["stage_id"],
                "tasks_started": (kind == TASK_START).astype("int64"),
                "tasks_complete": ends.astype("int64"),
                "tasks_failed": (ends & frame["task_failed"].astype(bool)).astype("int64"),
                "num_tasks": frame["num_tasks"].fillna(0).astype("int64"),
                "submitted": (kind == STAGE_SUBMITTED).astype("int64"),
                "complete": (kind == STAGE_COMPLETED).astype("int64"),
                "last_event": when.astype("int64"),
                "ended_at": when.where(kind == STAGE_COMPLETED, -1).astype("int64"),
            }
        )
        how = dict.fromkeys(_SUMS, "sum") | dict.fromkeys(_TOPS, "max")
        yield parts.groupby(["app_id", "stage_id"], as_index=False, dropna=False).agg(how)


def _closing(idle: int):
    """Keeps the counters of a bucket's stages until the watermark passes a stage's end, or its silence is too long."""
    names = ["app_id", "stage_id", *_SUMS, *_TOPS]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = pickle.loads(state.get[0]) if state.exists else None
        if not state.hasTimedOut:
            arrived = pd.concat([*([] if now is None else [now]), *(frame[names] for frame in frames)], ignore_index=True)
            stages = arrived.groupby(["app_id", "stage_id"], dropna=False, sort=False)
            now = pd.concat([stages[_SUMS].sum(), stages[_TOPS].max()], axis=1).reset_index()
        due = now["ended_at"].where(now["complete"] > 0, now["last_event"] + idle)
        over = due < state.getCurrentWatermarkMs()
        rest = now[~over]
        if len(rest):
            state.update((pickle.dumps(rest),))
            state.setTimeoutTimestamp(int(due[~over].min()))
        elif state.exists:
            state.remove()
        yield now[over]

    return step


def closed_stages(
    events: DataFrame,
    out: str,
    checkpoint: str,
    delay: str = "1 hour",
    idle: int = 7 * 24 * 3_600_000,
    trigger=AVAILABLE_NOW,
    buckets: int = 1024,
) -> StreamingQuery:
    """Appends each stage once it can no longer change; see :func:`closed_stage_rows`.

    A stage closes when the watermark is past its completion, or ``idle`` milliseconds past
    the last event of one that never completes (its application died). Its state is removed
    then, so the store holds the open stages only. Events without a stage or time are left out.

    Stages are looked after in ``buckets`` by hash, of which a task takes all stages at once:
    a call of Python per stage took far longer than its work. The number must stay as it is
    as long as the checkpoint is used.
    """
    rows = happened(of_kind(events, STAGE_SUBMITTED, STAGE_COMPLETED, TASK_START, TASK_END))
    known = stage_and_task_events(rows, "happened").where("stage_id IS NOT NULL AND happened IS NOT NULL")
    columns = ("app_id", "stage_id", "kind", "happened", "num_tasks", "task_failed")
    partial = known.select(*columns).mapInPandas(_partials, _PARTIAL)
    timed = partial.withColumn("event_time", F.timestamp_millis("last_event")).withWatermark("event_time", delay)
    dealt = timed.withColumn("bucket", F.pmod(F.xxhash64("app_id", "stage_id"), F.lit(buckets)))
    closed = dealt.groupBy("bucket").applyInPandasWithState(
        _closing(idle), _PARTIAL, "stages binary", "append", GroupStateTimeout.EventTimeTimeout
    )
    writer = closed.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(**trigger).start(out)


def closed_stage_rows(spark: SparkSession, out: str) -> DataFrame:
    """One row per closed stage; a stage that was closed and heard of again is summed up."""
    sums = [F.sum(n).alias(n) for n in _SUMS]
    flags = [(F.max(n) > 0).alias(n) for n in ("submitted", "complete")]
    times = [F.max("last_event").alias("last_event"), F.nullif(F.max("ended_at"), F.lit(-1)).alias("ended_at")]
    rows = spark.read.schema(_PARTIAL).parquet(out)
    return rows.groupBy("app_id", "stage_id").agg(F.max("num_tasks").alias("num_tasks"), *flags, *sums, *times)


# Owners of events, also of those that arrive before the start of their job


def _listings(events: DataFrame) -> DataFrame:
    starts = of_kind(events, JOB_START).where(F.col("Submission Time").isNotNull())
    return starts.select(
        F.col("app_id").alias("_app"),
        F.col("Job ID").alias("job_id"),
        F.timestamp_millis("Submission Time").alias("job_started"),
        F.explode(F.array_distinct("Stage IDs")).alias("_stage"),
    )


_WAITING = "app_id string, stage_id long, kind string, at long, num_tasks long, task_id long, task_failed boolean, event_time timestamp"
_OPEN = "_app string, job_id long, job_started timestamp, _stage long"
_NEWEST = "event timestamp, job timestamp"


def owned_stream(
    events: DataFrame,
    out: str,
    checkpoint: str,
    delay: str = "1 hour",
    horizon: str = "7 days",
    trigger=AVAILABLE_NOW,
) -> StreamingQuery:
    """Appends each stage and task event with the jobs that may own it; see :func:`owned_states`.

    An interval join of two streams: a job that lists the stage owns an event from its start
    until ``horizon`` later. Each batch joins its events with all open jobs and its jobs with
    the events that wait, so an event that arrives before the start of its job finds it in a
    later batch. The watermark trails the newest event or job, whichever is older, by
    ``delay``; what is not later than it when it arrives is left out. A job is closed when the
    watermark is past its horizon, and an event waits no longer when it is past the event.

    What is open is kept as tables in the checkpoint, as few bytes per row, and not in a state
    store, which held every event of a batch several times.
    """
    state = f"{checkpoint}/open"
    met = (
        (F.col("app_id") == F.col("_app"))
        & (F.col("stage_id") == F.col("_stage"))
        & (F.col("event_time") >= F.col("job_started"))
        & (F.col("event_time") <= F.col("job_started") + F.expr(f"INTERVAL {horizon}"))
    )

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = generations.read(spark, f"{state}/newest", _NEWEST, number - 1)
        mark = _watermark(newest, delay)
        rows = stage_and_task_events(batch).withColumn("event_time", F.timestamp_millis("at"))
        generations.write(rows.where(F.col("event_time") > mark), f"{state}/events", "batch", number)
        generations.write(_listings(batch).where(F.col("job_started") > mark), f"{state}/jobs", "batch", number)
        rows = spark.read.schema(_WAITING).parquet(f"{state}/events/batch={number}")
        jobs = spark.read.schema(_OPEN).parquet(f"{state}/jobs/batch={number}")
        waiting = generations.read(spark, f"{state}/events", _WAITING, number - 1)
        # Not as of this batch, which may have run before up to its end.
        known = generations.read(spark, f"{state}/jobs", _OPEN, number - 1).unionByName(jobs)
        found = rows.join(known, met).unionByName(waiting.join(jobs, met)).drop("_app", "_stage")
        generations.write(found, out, "batch", number)
        seen = rows.select(F.max("event_time").alias("event")).join(jobs.select(F.max("job_started").alias("job")))
        newest = newest.unionByName(seen).agg(F.max("event").alias("event"), F.max("job").alias("job"))
        generations.write(newest, f"{state}/newest", "gen", number)
        mark = _watermark(generations.read(spark, f"{state}/newest", _NEWEST, number), delay)
        generations.write(waiting.unionByName(rows).where(F.col("event_time") > mark), f"{state}/events", "gen", number)
        ends = F.col("job_started") + F.expr(f"INTERVAL {horizon}")
        generations.write(known.where(ends > mark), f"{state}/jobs", "gen", number)
        for table in ("newest", "events", "jobs"):
            generations.forget(spark, f"{state}/{table}", number)

    writer = events.writeStream.option("checkpointLocation", checkpoint)
    return writer.foreachBatch(add).trigger(**trigger).start()


def _watermark(newest: DataFrame, delay: str) -> Column:
    """``delay`` before the older of the newest event and the newest job start."""
    older = F.when(F.col("event").isNotNull() & F.col("job").isNotNull(), F.least("event", "job"))
    row = newest.select(F.unix_millis(older - F.expr(f"INTERVAL {delay}")).alias("mark")).first()
    return F.timestamp_millis(F.lit(max(0, (row and row["mark"]) or 0)))


def owned_states(spark: SparkSession, out: str, counters: list[Column]) -> DataFrame:
    """The counters per job and stage, each event counted for its latest job only.

    Where several jobs list a stage, an event was written once for each of them that had
    started. All events of a stage at one time have the same jobs, so the latest one is found
    by time. Events are shuffled once, by stage.
    """
    rows = spark.read.parquet(*generations.current(spark, out)).repartition(*LISTED)
    last = F.struct("job_started", "job_id")
    latest = F.max(last).over(Window.partitionBy(*LISTED, "at"))
    owned = rows.withColumn("_last", latest).where(F.col("_last").eqNullSafe(last))
    return owned.groupBy(*STAGE).agg(*counters)
