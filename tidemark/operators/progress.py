"""Job, stage and task state from a Spark event feed, and progress per job.

The feed is first reduced to three kinds of facts, and everything else is computed
from those, so the same rollups serve an event log and any table of the same shape:

* jobs: app_id, job_id, handle, name, type, started, stage_ids, complete, failed
* stages: app_id, job_id, stage_id, num_tasks, submitted, submitted_at,
  tasks_started, tasks_in_progress, tasks_complete, complete
* tasks: app_id, stage_id, task_id, started, finished

No result depends on the order of the feed: "latest" and "before" use the times in
the events, and job ids, which only grow within an application.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import at_least_one, progress, property_or_blank
from tidemark.operators import asof
from tidemark.operators.latest import latest_per_key, retained_jobs
from tidemark.session import checkpointed

APP_START = "SparkListenerApplicationStart"
JOB_START = "SparkListenerJobStart"
JOB_END = "SparkListenerJobEnd"
STAGE_SUBMITTED = "SparkListenerStageSubmitted"
STAGE_COMPLETED = "SparkListenerStageCompleted"
TASK_START = "SparkListenerTaskStart"
TASK_END = "SparkListenerTaskEnd"

#: The kinds of stage and task events, each with its place as a short code.
KINDS = (STAGE_SUBMITTED, STAGE_COMPLETED, TASK_START, TASK_END)

# The part that differs most comes first, since it sorts fastest.
JOB = ["job_id", "app_id"]
STAGE = ["stage_id", "job_id", "app_id"]
LISTED = ["stage_id", "app_id"]


def of_kind(events: DataFrame, *kinds: str) -> DataFrame:
    return events.where(F.col("Event").isin(*kinds))


def app_starts(events: DataFrame) -> DataFrame:
    """(app_id, app_name, started) per application start."""
    return of_kind(events, APP_START).select(
        "app_id", F.col("App Name").alias("app_name"), F.col("Timestamp").alias("started")
    )


JOB_CHANGE = (
    "job_id long, app_id string, _start struct<started: long, handle: string, name: string, "
    "type: string, stage_ids: array<long>>, complete boolean, failed boolean"
)


def job_changes(events: DataFrame) -> DataFrame:
    """What events tell of jobs: per job its start, if any, and whether it ended and failed.

    All of a job's start comes from one event, the latest, so that a start that is repeated
    with other values gives the same row in any order of the feed.
    """
    is_start = F.col("Event") == JOB_START
    is_end = F.col("Event") == JOB_END
    properties = F.col("Properties")
    start = F.struct(
        F.col("Submission Time").alias("started"),
        properties["spark.jobGroup.id"].alias("handle"),
        property_or_blank(properties, "spark.job.name").alias("name"),
        property_or_blank(properties, "spark.job.type").alias("type"),
        F.array_distinct("Stage IDs").alias("stage_ids"),
    )
    failed = is_end & (F.col("Job Result.Result") == "JobFailed")
    changes = of_kind(events, JOB_START, JOB_END).select(
        F.col("Job ID").alias("job_id"),
        "app_id",
        F.when(is_start, start).alias("_start"),
        is_end.alias("complete"),
        F.coalesce(failed, F.lit(False)).alias("failed"),
    )
    return merged_changes(changes)


def merged_changes(changes: DataFrame) -> DataFrame:
    """One row per job of several."""
    flags = [F.bool_or(name).alias(name) for name in ("complete", "failed")]
    return changes.groupBy(*JOB).agg(F.max("_start").alias("_start"), *flags)


def jobs_of_changes(changes: DataFrame) -> DataFrame:
    names = ("handle", "name", "type", "started", "stage_ids")
    return changes.where(F.col("_start").isNotNull()).select(
        *JOB, *[F.col(f"_start.{name}") for name in names], "complete", "failed"
    )


def jobs_from_events(events: DataFrame) -> DataFrame:
    """One row per started job, its end merged in; an end without a start is left out."""
    return jobs_of_changes(job_changes(events))


def stage_listings(jobs: DataFrame) -> DataFrame:
    """One row per stage a job lists: its ``position`` in the list and the job's start."""
    return jobs.select(
        *JOB, F.col("started").alias("job_started"), F.posexplode("stage_ids")
    ).select(*JOB, F.col("col").alias("stage_id"), F.col("pos").alias("position"), "job_started")


def stage_and_task_events(events: DataFrame, *also: str) -> DataFrame:
    """The stage and task events with one name for stage id and time of each kind.

    The time is the start of the stage or task, also for its end, so that both events of
    one thing have the same owner. ``also`` names further columns to keep.
    """
    kind = F.col("Event")
    info, task = F.col("`Stage Info`"), F.col("`Task Info`")
    of_stage = kind.isin(STAGE_SUBMITTED, STAGE_COMPLETED)
    at = (
        F.when(kind == STAGE_SUBMITTED, info["Submission Time"])
        .when(kind == STAGE_COMPLETED, F.coalesce(info["Submission Time"], info["Completion Time"]))
        .when(kind == TASK_START, task["Launch Time"])
        .when(kind == TASK_END, F.coalesce(task["Launch Time"], task["Finish Time"]))
    )
    return of_kind(events, STAGE_SUBMITTED, STAGE_COMPLETED, TASK_START, TASK_END).select(
        "app_id",
        F.when(of_stage, info["Stage ID"]).otherwise(F.col("Stage ID")).alias("stage_id"),
        kind.alias("kind"),
        at.alias("at"),
        F.when(kind == STAGE_SUBMITTED, info["Number of Tasks"]).alias("num_tasks"),
        task["Task ID"].alias("task_id"),
        F.coalesce(task["Failed"], F.lit(False)).alias("task_failed"),
        *also,
    )


def owned_events(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """Stage and task events with the job they belong to.

    The owner is the latest job that lists the stage and had started by then; an event
    of a stage no job has listed yet is dropped.
    """
    return _owned(stage_and_task_events(events), stage_listings(jobs).drop("position"))


def _owned(rows: DataFrame, owners: DataFrame) -> DataFrame:
    return asof.asof_join(rows, owners, LISTED, "at", "job_started", "job_id")


def stages_from_events(events: DataFrame, jobs: DataFrame, failed_count: bool = True) -> DataFrame:
    """Stage facts, one row per listed stage, with zeros for a stage still waiting.

    A failed task counts as complete, as does each retry, unless ``failed_count`` is off.

    By the ownership rule of :func:`owned_events`. Events and listings of a stage meet once, in
    order of time, and its state per job is summed up where they meet. Only a stage with so many
    of them that a task should not sort them all goes through the as-of join.
    """
    return facts_of(stage_state(owned_rows(events), stage_listings(jobs).drop("position"), counters(failed_count, coded=True)))


def stage_state(rows: DataFrame, listings: DataFrame, sums_of: list[Column]) -> DataFrame:
    """One row per listing with aggregates over the :func:`owned_rows` that it owns, if any."""
    plain, many = by_crowd(rows, listings)
    along = asof.along(*plain, LISTED, "at", "job_started", "job_id")
    # An event of a job without an id is its own, but no listing of such a job is found by it.
    job = F.when(F.col("_right"), F.col("job_id")).otherwise(F.col("_at.tie"))
    owned = along.withColumn("job_id", job).where(F.col("_right") | F.col("job_id").isNotNull())
    busy = many[1].select(*JOB, "stage_id").join(_owned(*many).groupBy(*STAGE).agg(*sums_of), STAGE, "left")
    return owned.groupBy(*STAGE).agg(*sums_of).unionByName(busy)


def by_crowd(rows: DataFrame, listings: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Both sides for the stages that a task may sort, and for those with too many rows."""
    # At most one stage for each million rows.
    hot = F.broadcast(asof.crowded([rows, listings], LISTED))
    plain, many = ([side.join(hot, LISTED, how) for side in (rows, listings)] for how in ("left_anti", "left_semi"))
    return plain, many


def owned_rows(events: DataFrame) -> DataFrame:
    """The :func:`stage_and_task_events` that may have an owner."""
    return coded(stage_and_task_events(events))


def coded(rows: DataFrame) -> DataFrame:
    """Rows of :func:`stage_and_task_events` that may have an owner, slim, since each is shuffled."""
    rows = rows.drop("task_id")
    for name in (*LISTED, "at"):
        rows = rows.where(F.col(name).isNotNull())
    code = F.lit(None).cast("byte")
    for n, name in enumerate(KINDS):
        code = F.when(F.col("kind") == name, F.lit(n).cast("byte")).otherwise(code)
    return rows.withColumn("kind", code)


def facts_of(state: DataFrame) -> DataFrame:
    """Stage facts from one row of counters per listing, null where it has no events."""
    no, zero = F.lit(False), F.lit(0).cast("long")
    return state.select(
        "app_id",
        "job_id",
        "stage_id",
        F.coalesce("num_tasks", zero).alias("num_tasks"),
        F.coalesce("submitted", no).alias("submitted"),
        "submitted_at",
        F.coalesce("tasks_started", zero).alias("tasks_started"),
        F.coalesce(F.col("tasks_started") - F.col("tasks_ended"), zero).alias("tasks_in_progress"),
        F.coalesce("tasks_complete", zero).alias("tasks_complete"),
        F.coalesce("complete", no).alias("complete"),
    )


def counters(failed_count: bool = True, coded: bool = False) -> list[Column]:
    """The state of a stage as aggregates over its :func:`stage_and_task_events`.

    ``coded`` if their kinds are places in ``KINDS``.
    """

    def of(name: str) -> Column:
        return F.col("kind") == (KINDS.index(name) if coded else name)

    ended = of(TASK_END)
    counted = ended if failed_count else ended & ~F.col("task_failed")
    return [
        F.max("num_tasks").alias("num_tasks"),
        F.bool_or(of(STAGE_SUBMITTED)).alias("submitted"),
        F.min(F.when(of(STAGE_SUBMITTED), F.col("at"))).alias("submitted_at"),
        F.count_if(of(TASK_START)).alias("tasks_started"),
        F.count_if(ended).alias("tasks_ended"),
        F.count_if(counted).alias("tasks_complete"),
        F.bool_or(of(STAGE_COMPLETED)).alias("complete"),
    ]


def facts_from_events(
    events: DataFrame, keep: int | None = None, failed_count: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Job and stage facts of a feed, of retained jobs only if ``keep`` is given.

    Job facts are few beside the feed but used several times, so they are checkpointed.
    """
    jobs = checkpointed(jobs_from_events(events))
    stages = stages_from_events(events, jobs, failed_count)
    if keep is None:
        return jobs, stages
    kept = retained_jobs(jobs, keep)
    return kept, stages.join(kept.select(*JOB), JOB, "left_semi")


def tasks_from_events(events: DataFrame) -> DataFrame:
    """Launch and finish time per task, and how long it took."""
    return _tasks(_task_times(events))


def _task_times(events: DataFrame) -> DataFrame:
    task = F.col("`Task Info`")
    return of_kind(events, TASK_START, TASK_END).select(
        "app_id",
        F.col("Stage ID").alias("stage_id"),
        task["Task ID"].alias("task_id"),
        task["Launch Time"].alias("_launch"),
        F.when(F.col("Event") == TASK_END, task["Finish Time"]).alias("_finish"),
    )


def _tasks(times: DataFrame) -> DataFrame:
    return (
        times.groupBy("app_id", "stage_id", "task_id")
        .agg(F.max("_launch").alias("started"), F.max("_finish").alias("finished"))
        .withColumn("duration", F.col("finished") - F.col("started"))
    )


def owned_tasks(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """The tasks of :func:`tasks_from_events` with the job that each belongs to.

    The owner is that of :func:`owned_events`; null where no job had listed the stage
    when the task was launched. Events and listings of a stage are shuffled to one place, where
    the tasks are put together and meet the listings, but for stages with so many that they go
    through the as-of join.
    """
    times, listings = _task_times(events), stage_listings(jobs).drop("position")
    named = F.col("stage_id").isNotNull() & F.col("app_id").isNotNull()
    plain, many = by_crowd(times.where(named), listings.where(named))
    both = asof.together(*plain, LISTED, "_launch", "job_started").repartition(*LISTED)
    # A listing is a group of its own.
    listed = F.when(F.col("_right"), F.col("_time")).alias("_listed")
    merged = both.groupBy(*LISTED, "task_id", "job_id", "_right", listed).agg(F.max("_time").alias("_time"), F.max("_finish").alias("finished"))
    tasks = asof.in_order(merged, LISTED, "job_id").where(~F.col("_right")).select(
        "app_id",
        "stage_id",
        "task_id",
        F.col("_time").alias("started"),
        "finished",
        (F.col("finished") - F.col("_time")).alias("duration"),
        F.col("_at.tie").alias("job_id"),
    )
    rest = _tasks(many[0].unionByName(times.where(~named)))
    busy = asof.asof_join(rest, many[1], LISTED, "started", "job_started", "job_id", how="left")
    return tasks.unionByName(busy.drop("job_started"))


def stage_states(stages: DataFrame) -> DataFrame:
    """Per job the stages waiting, in progress and complete, as (…, stage_id, state) rows."""
    state = F.when(F.col("complete"), "complete").when(F.col("submitted"), "in_progress")
    return stages.select(*STAGE, state.otherwise("waiting").alias("state"))


def stage_lists(jobs: DataFrame, stages: DataFrame) -> DataFrame:
    """The same as three arrays per job.

    An array holds at most the ids the job's own start event lists in one row, so
    nothing is gathered that was not together before. For tables without such a list
    use :func:`stage_states`.
    """

    def ids(state: str) -> Column:
        return F.sort_array(F.collect_set(F.when(F.col("state") == state, F.col("stage_id"))))

    lists = stage_states(stages).groupBy(*JOB).agg(
        ids("waiting").alias("waiting"),
        ids("in_progress").alias("in_progress"),
        ids("complete").alias("complete"),
    )
    none = F.array().cast("array<bigint>")
    filled = [F.coalesce(name, none).alias(name) for name in ("waiting", "in_progress", "complete")]
    return jobs.select(*JOB).join(lists, JOB, "left").select(*JOB, *filled)


def job_rollup(stages: DataFrame) -> DataFrame:
    """Per job: stages, complete stages, and the first submitted stage still in progress."""
    in_progress = F.col("submitted") & ~F.col("complete")
    stage = F.struct("submitted_at", "stage_id", "num_tasks", "tasks_complete")
    return stages.groupBy(*JOB).agg(
        F.count(F.lit(1)).alias("total_stages"),
        F.count_if("complete").alias("complete_stages"),
        F.min(F.when(in_progress, stage)).alias("current"),
    )


def job_progress(jobs: DataFrame, stages: DataFrame) -> DataFrame:
    """Progress of every job; a job without stages shows 1 of 1.

    ``done`` repeats the end of the job itself, since a finished job with skipped stages
    stays below 1. The current-stage columns are null where no stage is in progress.
    """
    zero = F.lit(0).cast("long")
    joined = jobs.select(*JOB, "handle", "name", "type", "started", "complete", "failed").join(
        job_rollup(stages), JOB, "left"
    )
    total = F.coalesce("total_stages", zero)
    done = F.coalesce("complete_stages", zero)
    current = F.col("current")
    tasks, ended = current["num_tasks"], current["tasks_complete"]
    return joined.select(
        *JOB,
        "handle",
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("type", F.lit("")).alias("type"),
        "started",
        "complete",
        "failed",
        at_least_one(total, total).alias("total_stages"),
        at_least_one(done, total).alias("complete_stages"),
        progress(done, total).alias("stage_progress"),
        current["stage_id"].alias("current_stage"),
        at_least_one(tasks, tasks).alias("current_tasks"),
        at_least_one(ended, tasks).alias("current_complete_tasks"),
        F.when(current.isNotNull(), progress(ended, tasks)).alias("task_progress"),
    )


def of_type(jobs: DataFrame, job_type: str | None) -> DataFrame:
    """Jobs of one type, or all; a job without a type does not match."""
    return jobs if job_type is None else jobs.where(F.col("type") == job_type)


def running_count(jobs: DataFrame, *keys: str) -> DataFrame:
    """Number of jobs that have not ended, in all or per group."""
    return jobs.groupBy(*keys).agg(F.count_if(~F.col("complete")).alias("running"))


def latest_jobs(
    jobs: DataFrame, handle: str | None = None, keys=("handle", "app_id"), order=("job_id",)
) -> DataFrame:
    """The latest job of each handle, or of one; an unknown handle gives no row."""
    if handle is not None:
        jobs = jobs.where(F.col("handle") == handle)
    return latest_per_key(jobs, list(keys), list(order))


def handle_progress(
    jobs: DataFrame,
    stages: DataFrame,
    runs: DataFrame,
    handle: str | None = None,
    order=("started", "job_id"),
) -> DataFrame:
    """Progress of each handle's latest job, with the ``running`` flag of its run history.

    A run that has started no job yet shows its flag alone.
    """
    latest = job_progress(latest_jobs(jobs, handle, order=order), stages)
    flags = runs.select(F.col("job_handle").alias("handle"), "running")
    if handle is not None:
        flags = flags.where(F.col("handle") == handle)
    return latest.join(flags, "handle", "outer").withColumn(
        "running", F.coalesce("running", F.lit(False))
    )


def handle_rollup(progress_rows: DataFrame) -> DataFrame:
    """All jobs of a handle together: jobs, jobs done and failed, stages and progress."""
    rollup = progress_rows.where(F.col("handle").isNotNull()).groupBy("app_id", "handle").agg(
        F.count(F.lit(1)).alias("jobs"),
        F.count_if("complete").alias("complete_jobs"),
        F.count_if("failed").alias("failed_jobs"),
        F.sum("total_stages").alias("total_stages"),
        F.sum("complete_stages").alias("complete_stages"),
    )
    share = progress(F.col("complete_stages"), F.col("total_stages"))
    return rollup.withColumn("stage_progress", share)
