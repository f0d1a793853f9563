import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import asof
from tidemark.operators import progress as P
from tidemark.operators.history import run_state
from tidemark.operators.asof import with_parts
from tidemark.operators.latest import best_per_group, latest_per_key, retained_jobs
from tidemark.sources.event_log import read_events, write_events


def job_start(job, stages, at, **properties):
    props = {f"spark.{k.replace('_', '.')}": v for k, v in properties.items()}
    return {"Event": P.JOB_START, "Job ID": job, "Stage IDs": stages, "Properties": props, "Submission Time": at}


def job_end(job, result="JobSucceeded"):
    return {"Event": P.JOB_END, "Job ID": job, "Job Result": {"Result": result}}


def submitted(stage, tasks, at):
    return {"Event": P.STAGE_SUBMITTED, "Stage Info": {"Stage ID": stage, "Number of Tasks": tasks, "Submission Time": at}}


def completed(stage, start, at):
    info = {"Stage ID": stage, "Submission Time": start, "Completion Time": at}
    return {"Event": P.STAGE_COMPLETED, "Stage Info": info}


def task_start(stage, task, at):
    return {"Event": P.TASK_START, "Stage ID": stage, "Task Info": {"Task ID": task, "Launch Time": at}}


def task_end(stage, task, start, at, failed=False):
    info = {"Task ID": task, "Launch Time": start, "Finish Time": at, "Failed": failed}
    return {"Event": P.TASK_END, "Stage ID": stage, "Task Info": info}


LOG = [
    {"Event": "SparkListenerApplicationStart", "App Name": "demo", "Timestamp": 5},
    # Job 0: stage 1 is skipped, the job ends.
    job_start(0, [0, 1], 10, jobGroup_id="h1", job_type="sql", job_name="first"),
    submitted(0, 1, 11), task_start(0, 0, 12), task_end(0, 0, 12, 13), completed(0, 11, 14), job_end(0),
    # Job 1 fails; a task is retried.
    job_start(1, [2], 20, jobGroup_id="h2", job_type="python"),
    submitted(2, 2, 21), task_start(2, 1, 22), task_start(2, 2, 22), task_end(2, 1, 22, 25, failed=True),
    task_start(2, 3, 26), task_end(2, 3, 26, 27), job_end(1, "JobFailed"),
    # Job 2 runs: stage 3 is half done, stage 4 waits; it has no type, and is h1's latest.
    job_start(2, [3, 4, 3], 30, jobGroup_id="h1"),
    submitted(3, 4, 31), task_start(3, 4, 32), task_start(3, 5, 32), task_start(3, 6, 32),
    task_end(3, 4, 32, 40), task_end(3, 5, 32, 41),
    # Job 3 has no stages.
    job_start(3, [], 50), job_end(3),
    # Job 4: a stage with zero tasks in progress.
    job_start(4, [5], 60), submitted(5, 0, 61),
    # Jobs 5 and 6 list stage 6; what starts from the start of the later one on is its own.
    job_start(5, [6, 7], 70), submitted(6, 3, 71), task_start(6, 7, 72), task_end(6, 7, 72, 79),
    job_start(6, [6], 80), task_start(6, 8, 80), task_end(6, 8, 80, 83), completed(6, 71, 84),
    # Of a stage nobody lists, and of one before its job starts.
    submitted(99, 9, 1), task_start(7, 9, 69),
    # An end without a start, an unknown kind of event.
    job_end(77), {"Event": "SparkListenerBlockManagerAdded", "Timestamp": 3},
]


def write_log(folder, events, name="app-1", shuffle=None):
    lines = [json.dumps(e) for e in events] + ["{ broken", ""]
    if shuffle is not None:
        random.Random(shuffle).shuffle(lines)
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")
    return str(folder)


@pytest.fixture(autouse=True, params=["whole keys", "cut keys"])
def size(request, monkeypatch):
    """Every test runs with the keys of as-of joins as they are and cut into parts."""
    if request.param == "cut keys":
        monkeypatch.setattr(asof, "HOT_ROWS", 1)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    return read_events(spark, write_log(tmp_path_factory.mktemp("log"), LOG))


def state(events, **options):
    jobs = P.jobs_from_events(events)
    return jobs, P.stages_from_events(events, jobs, **options)


def test_application_start(events):
    assert rows(P.app_starts(events)) == [("app-1", "demo", 5)]


def test_jobs(events):
    jobs, _ = state(events)
    assert rows(jobs, "job_id", "handle", "name", "type", "started", "complete", "failed") == [
        (0, "h1", "first", "sql", 10, True, False),
        (1, "h2", "", "python", 20, True, True),
        (2, "h1", "", "", 30, False, False),
        (3, None, "", "", 50, True, False),
        (4, None, "", "", 60, False, False),
        (5, None, "", "", 70, False, False),
        (6, None, "", "", 80, False, False),
    ]
    assert P.running_count(jobs).first()[0] == 4
    assert rows(P.of_type(jobs, "sql"), "job_id") == [(0,)]
    assert P.of_type(jobs, None).count() == 7


STAGES = [
    # job, stage, num_tasks, submitted, at, started, in progress, complete tasks, complete
    (0, 0, 1, True, 11, 1, 0, 1, True),
    (0, 1, 0, False, None, 0, 0, 0, False),
    (1, 2, 2, True, 21, 3, 1, 2, False),
    (2, 3, 4, True, 31, 3, 1, 2, False),
    (2, 4, 0, False, None, 0, 0, 0, False),
    (4, 5, 0, True, 61, 0, 0, 0, False),
    (5, 6, 3, True, 71, 1, 0, 1, True),
    (5, 7, 0, False, None, 0, 0, 0, False),
    (6, 6, 0, False, None, 1, 0, 1, False),
]


@pytest.mark.parametrize("shuffle", [None, 1, 2])
def test_stages_whatever_the_order(spark, tmp_path, shuffle):
    events = read_events(spark, write_log(tmp_path / "log", LOG, shuffle=shuffle))
    assert rows(state(events)[1].drop("app_id")) == STAGES


def test_failed_tasks_can_be_left_out(events):
    stages = state(events, failed_count=False)[1].where("stage_id = 2")
    assert rows(stages, "tasks_in_progress", "tasks_complete") == [(1, 1)]


def test_progress(events):
    names = ["job_id", "total_stages", "complete_stages", "stage_progress", "current_stage",
             "current_tasks", "current_complete_tasks", "task_progress"]
    assert rows(P.job_progress(*state(events)), *names) == [
        (0, 2, 1, 0.5, None, None, None, None),
        (1, 1, 0, 0.0, 2, 2, 2, 1.0),
        (2, 2, 0, 0.0, 3, 4, 2, 0.5),
        (3, 1, 1, 1.0, None, None, None, None),
        (4, 1, 0, 0.0, 5, 1, 1, 1.0),
        (5, 2, 1, 0.5, None, None, None, None),
        (6, 1, 0, 0.0, None, None, None, None),
    ]


def test_stage_states_and_lists(events):
    jobs, stages = state(events)
    assert rows(P.stage_states(stages).where("job_id = 2"), "stage_id", "state") == [
        (3, "in_progress"), (4, "waiting")
    ]
    lists = {r["job_id"]: (r["waiting"], r["in_progress"], r["complete"]) for r in P.stage_lists(jobs, stages).collect()}
    assert lists[0] == ([1], [], [0])
    assert lists[2] == ([4], [3], [])
    assert lists[3] == ([], [], [])


def test_task_times(events):
    tasks = P.tasks_from_events(events)
    assert rows(tasks.where("stage_id = 2"), "task_id", "started", "finished", "duration") == [
        (1, 22, 25, 3), (2, 22, None, None), (3, 26, 27, 1)
    ]


def test_handles(spark, events):
    jobs, stages = state(events)
    history = [
        ("h1", "job_start", 1), ("h1", "job_complete", 2), ("h1", "job_start", 3),
        ("h2", "job_start", 1), ("h2", "job_complete", 2), ("h3", "job_start", 4),
    ]
    runs = run_state(spark.createDataFrame(history, "job_handle string, event string, ts long"))
    found = P.handle_progress(jobs, stages, runs)
    assert rows(found, "handle", "job_id", "task_progress", "running") == [
        ("h1", 2, 0.5, True), ("h2", 1, 1.0, False), ("h3", None, None, True)
    ]
    assert rows(P.handle_progress(jobs, stages, runs, "h2"), "job_id") == [(1,)]
    assert P.handle_progress(jobs, stages, runs, "unknown").count() == 0
    rollup = P.handle_rollup(P.job_progress(jobs, stages))
    assert rows(rollup, "handle", "jobs", "complete_jobs", "stage_progress") == [
        ("h1", 2, 1, 0.25), ("h2", 1, 1, 0.0)
    ]


def test_several_applications_stay_apart(spark, tmp_path):
    write_log(tmp_path / "logs", LOG, "app-1", shuffle=3)
    path = write_log(tmp_path / "logs", LOG, "app-2", shuffle=4)
    stages = state(read_events(spark, path))[1]
    for app in ("app-1", "app-2"):
        assert rows(stages.where(F.col("app_id") == app).drop("app_id")) == STAGES


def test_event_store_by_kind_gives_the_same(spark, tmp_path, events):
    path = str(tmp_path / "store")
    write_events(events, path)
    stored = spark.read.parquet(path)
    assert rows(state(stored)[1].drop("app_id")) == STAGES
    plan = P.jobs_from_events(stored)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [Event" in plan and "Task Info" not in plan


def test_hot_stage_is_spread_and_exact(spark, monkeypatch):
    """One stage with nearly all task events, on a job that another job follows."""
    monkeypatch.setattr(asof, "HOT_ROWS", 500)
    tasks = spark.range(4000).select(
        F.lit("a").alias("app_id"), F.lit(P.TASK_START).alias("Event"), F.lit(1).cast("long").alias("Stage ID"),
        F.struct(F.col("id").alias("Task ID"), F.col("id").alias("Launch Time"), F.lit(None).cast("long").alias("Finish Time"),
                 F.lit(False).alias("Failed")).alias("Task Info"),
    )
    starts = spark.createDataFrame(
        [("a", P.JOB_START, 1, [1, 2], 1000), ("a", P.JOB_START, 2, [1], 3000)],
        "app_id string, Event string, `Job ID` long, `Stage IDs` array<long>, `Submission Time` long",
    )
    from tidemark.schemas import EVENT

    empty = spark.createDataFrame([], EVENT)
    events = tasks.unionByName(starts, allowMissingColumns=True).unionByName(empty, allowMissingColumns=True)
    stages = state(events)[1]
    assert rows(stages, "job_id", "stage_id", "tasks_started") == [(1, 1, 2000), (1, 2, 0), (2, 1, 1000)]
    # Dealt out by parts of its times, so that no task sees the whole stage.
    text = stages._jdf.queryExecution().executedPlan().toString()
    assert "_part" in text and "partial_count" in text


def test_owned_events(events):
    jobs, _ = state(events)
    owned = P.owned_events(events, jobs).where("stage_id = 6")
    assert rows(owned, "kind", "at", "job_id") == [
        (P.STAGE_COMPLETED, 71, 5), (P.STAGE_SUBMITTED, 71, 5), (P.TASK_END, 72, 5),
        (P.TASK_END, 80, 6), (P.TASK_START, 72, 5), (P.TASK_START, 80, 6),
    ]


def test_retention(spark):
    jobs = spark.range(300).selectExpr(
        "concat('app', id % 2) AS app_id", "id AS job_id", "id DIV 4 AS started", "id % 10 <> 0 AS complete"
    )
    # Evens: 30 run, so the 70 newest completed stay. Odds: none run, 100 stay.
    kept = {r["job_id"] for r in retained_jobs(jobs).collect()}
    evens = [i for i in range(0, 300, 2)]
    done = [i for i in evens if i % 10 != 0]
    expected = {i for i in evens if i % 10 == 0} | set(done[-70:]) | set(range(1, 300, 2)[-100:])
    assert kept == expected
    assert retained_jobs(jobs, keep=10).where("app_id = 'app0'").count() == 30
    assert "WindowGroupLimit" in retained_jobs(jobs)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ascending", [True, False])
def test_many_rows_of_a_group_are_chosen_in_several_tasks(spark, monkeypatch, ascending):
    monkeypatch.setattr(asof, "HOT_ROWS", 1000)
    df = spark.range(0, 9000, 1, 4).selectExpr("IF(id < 7000, 'hot', IF(id < 8995, 'mid', NULL)) AS g", "id * 7919 % 9001 AS v", "id")
    found = best_per_group(df, ["g"], F.struct("v", "id"), 5000, ascending, part_rows=1000)
    want = []
    for group in ("hot", "mid", None):
        own = sorted((r["v"], r["id"]) for r in df.where(F.col("g").eqNullSafe(F.lit(group))).collect())
        want += [(group, v, i, n) for n, (v, i) in enumerate((own if ascending else own[::-1])[:5000], 1)]
    assert rows(found) == sorted(want, key=lambda t: [(x is None, str(x)) for x in t])
    assert rows(best_per_group(df, ["g"], F.struct("v", "id"), 700, ascending)) == [r for r in rows(found) if r[3] <= 700]
    # No task ranks a whole hot group, and what stands behind the k-th row is not ranked.
    cut = with_parts(df.withColumn("_time", F.struct("v", "id")), ["g"], 1000).where("g = 'hot'")
    sizes = [r["count"] for r in cut.groupBy("_part").count().collect()]
    assert len(sizes) > 5 and max(sizes) < 2000


def test_retention_of_more_rows_than_tasks_cut(spark, monkeypatch):
    jobs = spark.range(6000).selectExpr("'a' AS app_id", "id AS job_id", "id DIV 4 AS started", "id % 10 <> 0 AS complete")
    monkeypatch.setattr(asof, "HOT_ROWS", 500)
    kept = sorted(r["job_id"] for r in retained_jobs(jobs, keep=2000).collect())
    running = [i for i in range(6000) if i % 10 == 0]
    assert kept == sorted(running + [i for i in range(6000) if i % 10][-(2000 - len(running)) :])


def test_latest_per_key(spark):
    df = spark.createDataFrame([("a", 1, 1, "x"), ("a", 1, 2, "y"), ("a", 0, 9, "z"), (None, 5, 5, "n")], "k string, d int, i int, v string")
    assert rows(latest_per_key(df, ["k"], ["d", "i"])) == [("a", 1, 2, "y")]


def test_stages_shuffle_events_and_listings_once(spark, monkeypatch):
    """Stages that a job enters midway were read, shuffled and kept several times."""
    monkeypatch.setattr(asof, "HOT_ROWS", 1000)
    tasks = spark.range(3000).select(
        F.lit("a").alias("app_id"), F.lit(P.TASK_START).alias("Event"), (F.col("id") % 300).alias("Stage ID"),
        F.struct(F.col("id").alias("Task ID"), F.col("id").alias("Launch Time"), F.lit(None).cast("long").alias("Finish Time"),
                 F.lit(False).alias("Failed")).alias("Task Info"),
    )
    jobs = spark.range(300).selectExpr("id AS job_id", "'a' AS app_id", "1500L AS started", "array(id) AS stage_ids")
    info = spark.createDataFrame([], "`Stage Info` struct<`Stage ID`: long, `Number of Tasks`: long, `Submission Time`: long, `Completion Time`: long>")
    events = tasks.unionByName(info, allowMissingColumns=True)
    tracker, group = spark.sparkContext.statusTracker(), "stages plan"
    spark.sparkContext.setJobGroup(group, group)
    try:
        stages = P.stages_from_events(events, jobs).select("tasks_started")
        assert not tracker.getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert rows(stages) == [(5,)] * 300
    ran = stages._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in ran and ran.count("Window") == 1
    assert "SortMergeJoin" not in ran


@pytest.mark.parametrize("seed", range(3))
def test_stages_equal_brute_force_with_nulls(spark, tmp_path, seed):
    rng = random.Random(seed)

    def some(n):
        return None if rng.random() < 0.1 else rng.randrange(n)

    log = [job_start(j, [some(6) for _ in range(rng.randrange(5))], some(20)) for j in range(8)]
    log += [submitted(some(6), some(9), some(20)) for _ in range(9)] + [completed(some(6), some(20), some(20)) for _ in range(6)]
    log += [task_start(some(6), t, some(20)) for t in range(40)] + [task_end(some(6), t, some(20), some(20), rng.random() < 0.3) for t in range(30)]
    want = []
    starts = [e for e in log if e["Event"] == P.JOB_START]
    for start in starts:
        for stage in set(start["Stage IDs"]):
            own = []
            for e in log:
                info = e.get("Stage Info") or e.get("Task Info")
                if info is None:
                    continue
                is_stage = "Stage Info" in e
                began, ended = ("Submission Time", "Completion Time") if is_stage else ("Launch Time", "Finish Time")
                at = info.get(began) if info.get(began) is not None or e["Event"] in (P.STAGE_SUBMITTED, P.TASK_START) else info.get(ended)
                its = info["Stage ID"] if is_stage else e["Stage ID"]
                if None in (at, its, stage) or its != stage:
                    continue
                before = [(s["Submission Time"], s["Job ID"]) for s in starts if stage in s["Stage IDs"] and s["Submission Time"] is not None and s["Submission Time"] <= at]
                if before and max(before)[1] == start["Job ID"]:
                    own.append((e["Event"], at, info.get("Number of Tasks"), info.get("Failed")))
            kinds = [o[0] for o in own]
            submits = [o for o in own if o[0] == P.STAGE_SUBMITTED]
            begun, over = kinds.count(P.TASK_START), kinds.count(P.TASK_END)
            good = sum(o[0] == P.TASK_END and not o[3] for o in own)
            want.append((start["Job ID"], stage, max([o[2] for o in submits if o[2] is not None], default=0), bool(submits),
                         min([o[1] for o in submits], default=None), begun, begun - over, over, P.STAGE_COMPLETED in kinds, good))
    events = read_events(spark, write_log(tmp_path / "log", log))
    order = lambda t: [(x is None, str(x)) for x in t]
    assert rows(state(events)[1].drop("app_id")) == sorted((w[:-1] for w in want), key=order)
    names = ("job_id", "stage_id", "tasks_complete")
    assert rows(state(events, failed_count=False)[1], *names) == sorted(((w[0], w[1], w[9]) for w in want), key=order)


@pytest.mark.parametrize("seed", range(2))
def test_owned_tasks_equal_brute_force_with_nulls(spark, tmp_path, seed):
    rng = random.Random(seed)

    def some(n):
        return None if rng.random() < 0.1 else rng.randrange(n)

    log = [job_start(j, [some(6) for _ in range(rng.randrange(5))], some(20)) for j in range(8)]
    log += [task_start(some(6), some(30), some(20)) for _ in range(60)] + [task_end(some(6), some(30), some(20), some(40)) for _ in range(60)]
    tasks, starts = {}, [e for e in log if e["Event"] == P.JOB_START]
    for e in log:
        if e["Event"] in (P.TASK_START, P.TASK_END):
            info = e["Task Info"]
            launches, finishes = tasks.setdefault((e["Stage ID"], info["Task ID"]), ([], []))
            launches.append(info["Launch Time"])
            finishes.append(info.get("Finish Time"))
    want = []
    for (stage, task), times in tasks.items():
        started, finished = (max((t for t in ts if t is not None), default=None) for ts in times)
        before = [
            (s["Submission Time"], s["Job ID"])
            for s in starts
            if stage is not None and started is not None and stage in s["Stage IDs"] and s["Submission Time"] is not None and s["Submission Time"] <= started
        ]
        took = None if None in (started, finished) else finished - started
        want.append((stage, task, started, finished, took, max(before)[1] if before else None))
    events = read_events(spark, write_log(tmp_path / "log", log))
    found = P.owned_tasks(events, P.jobs_from_events(events))
    assert found.columns == ["app_id", "stage_id", "task_id", "started", "finished", "duration", "job_id"]
    assert rows(found.drop("app_id")) == sorted(want, key=lambda t: [(x is None, str(x)) for x in t])


def test_owned_tasks_shuffle_events_and_listings_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(asof, "HOT_ROWS", 1000)
    write_events(read_events(spark, write_log(tmp_path / "log", LOG)), str(tmp_path / "store"))
    events = spark.read.parquet(str(tmp_path / "store"))
    found = P.owned_tasks(events, P.jobs_from_events(events)).select("stage_id", "task_id", "job_id")
    assert (6, 7, 5) in rows(found) and (6, 8, 6) in rows(found)
    ran = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in ran and ran.count("Window") == 1 and "SortMergeJoin" not in ran
