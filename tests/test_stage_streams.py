"""Streams that close stages and find owners, in several batches against the batch rollups."""

import json
import random

import pytest
from conftest import rows
from test_progress import LOG, completed, job_start, submitted, task_end, task_start

from tidemark.operators import progress as P
from tidemark.sources.event_log import read_events, stream_events
from tidemark.streaming import stages as S


@pytest.fixture
def feed(spark, tmp_path):
    """Adds a file of events to a folder and runs a stream over what is new; gives its last progress."""
    folder = tmp_path / "log"
    folder.mkdir()

    def run(stream, events, **options):
        (folder / f"part-{len(list(folder.iterdir()))}").write_text("\n".join(map(json.dumps, events)))
        out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
        query = stream(stream_events(spark, str(folder), "app-1"), out, checkpoint, **options)
        query.awaitTermination()
        return query.lastProgress

    return run, str(folder), str(tmp_path / "out")


def held(progress):
    return sum(s["numRowsTotal"] for s in progress["stateOperators"])


def stage(number, at, tasks=2, ends=True):
    first = 10 * number
    starts = [submitted(number, tasks, at), *(task_start(number, first + t, at + 1 + t) for t in range(tasks))]
    last = [*(task_end(number, first + t, at + 1 + t, at + 50, failed=t == 0) for t in range(tasks)), completed(number, at, at + 60)]
    return starts + last * ends


def test_ended_stages_close_and_leave_the_store(spark, feed):
    run, _, out = feed
    options = {"delay": "20 milliseconds", "idle": 1000}
    closed, sizes = [], []
    for k in range(7):
        progress = run(S.closed_stages, stage(k, 1000 + 100 * k), **options)
        sizes.append(held(progress))
        closed.append(S.closed_stage_rows(spark, out).count())
    # A stage closes once the watermark, 20 behind the end of a later one, is past its own end.
    assert closed == list(range(7))
    assert max(sizes) <= 2
    found = rows(S.closed_stage_rows(spark, out), "stage_id", "num_tasks", "submitted", "complete", "tasks_started", "tasks_complete", "tasks_failed", "last_event", "ended_at")
    want = [(k, 2, True, True, 2, 2, 1, 1060 + 100 * k, 1060 + 100 * k) for k in range(6)]
    assert found == sorted(want, key=lambda t: [(False, str(x)) for x in t])


def test_stages_over_batches_late_events_and_silence(spark, feed):
    run, _, out = feed
    options = {"delay": "100 milliseconds", "idle": 1000}
    parts = stage(1, 1000, tasks=40)
    run(S.closed_stages, parts[:20] + stage(2, 1000, ends=False), **options)
    run(S.closed_stages, parts[20:60], **options)
    # The completion comes before some ends of tasks, all within the delay.
    run(S.closed_stages, [parts[-1], *parts[60:70]], **options)
    run(S.closed_stages, parts[70:-1], **options)
    assert S.closed_stage_rows(spark, out).count() == 0
    run(S.closed_stages, stage(3, 1500), **options)
    done = S.closed_stage_rows(spark, out)
    assert rows(done, "stage_id", "tasks_started", "tasks_complete", "complete") == [(1, 40, 40, True)]
    # Too late: the watermark is at 1460.
    run(S.closed_stages, [task_end(1, 10, 1001, 1055)], **options)
    assert rows(done, "tasks_complete") == [(40,)]
    # The stage that fell silent at 1002 closes when the watermark is 1000 later.
    progress = run(S.closed_stages, stage(4, 2100), **options)
    assert rows(S.closed_stage_rows(spark, out), "stage_id", "complete") == [(1, True), (2, False), (3, True)]
    assert held(progress) == 1


def owned(spark, out):
    return rows(S.owned_states(spark, out, P.counters()).drop("submitted_at"))


def in_batch(spark, folder):
    events = read_events(spark, folder, "app-1")
    whole = P.owned_events(events, P.jobs_from_events(events))
    return rows(whole.groupBy(*P.STAGE).agg(*P.counters()).drop("submitted_at"))


def test_events_before_their_job_start_find_their_owner_later(spark, feed):
    run, folder, out = feed
    options = {"delay": "10 seconds", "horizon": "1 day"}
    start, *rest = [job_start(7, [1, 2], 900), *stage(1, 1000), *stage(2, 1200)]
    run(S.owned_stream, rest[:4], **options)
    assert owned(spark, out) == []
    run(S.owned_stream, [start, *rest[4:6]], **options)
    assert owned(spark, out) == in_batch(spark, folder) != []
    run(S.owned_stream, rest[6:], **options)
    assert owned(spark, out) == in_batch(spark, folder)


@pytest.mark.parametrize("seed", [1, 2])
def test_owners_in_any_order_of_arrival_equal_the_batch(spark, feed, seed):
    run, folder, out = feed
    log = [*LOG, LOG[-1]]
    random.Random(seed).shuffle(log)
    for k in range(3):
        run(S.owned_stream, log[k::3], delay="1 hour", horizon="1 day")
    assert owned(spark, out) == in_batch(spark, folder)


def test_the_join_forgets_what_is_over(spark, feed):
    run, folder, out = feed
    sizes = []
    for k in range(1, 7):
        events = [job_start(k, [k], 1000 * k), *stage(k, 1000 * k + 5, tasks=5)]
        sizes.append(held(run(S.owned_stream, events, delay="100 milliseconds", horizon="500 milliseconds")))
    assert max(sizes[3:]) <= max(sizes[:3]) < 60
    assert owned(spark, out) == in_batch(spark, folder)


def test_many_stages_share_a_bucket(spark, feed):
    run, _, out = feed
    options = {"delay": "20 milliseconds", "idle": 1000, "buckets": 4}
    some = [e for k in range(1, 41) for e in stage(k, 1000, ends=k % 2 == 0)]
    assert held(run(S.closed_stages, some, **options)) <= 4
    run(S.closed_stages, stage(50, 1500), **options)
    assert S.closed_stage_rows(spark, out).count() == 20
    run(S.closed_stages, stage(51, 3000), **options)
    found = rows(S.closed_stage_rows(spark, out), "stage_id", "tasks_started", "tasks_complete", "tasks_failed", "complete")
    want = [(k, 2, 2, 1, True) if k % 2 == 0 else (k, 2, 0, 0, False) for k in range(1, 41)]
    assert found == sorted([*want, (50, 2, 2, 1, True)], key=lambda t: [(False, str(x)) for x in t])


def test_the_join_keeps_no_state_store_and_few_rows(spark, feed, tmp_path):
    run, folder, out = feed
    for k in range(1, 4):
        events = [job_start(k, [k], 1000 * k), *stage(k, 1000 * k + 5, tasks=5)]
        assert held(run(S.owned_stream, events, delay="100 milliseconds", horizon="500 milliseconds")) == 0
    state = tmp_path / "checkpoint" / "open"
    assert spark.read.parquet(str(state / "events" / "gen=2")).count() <= 12
    assert rows(spark.read.parquet(str(state / "jobs" / "gen=2")), "job_id") == [(3,)]
    assert owned(spark, out) == in_batch(spark, folder)
