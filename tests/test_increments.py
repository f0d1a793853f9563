"""Progress kept up to date batch by batch, against the batch rollups over all events so far."""

import json
import random
from pathlib import Path

import pytest
from conftest import rows
from test_progress import LOG, completed, job_start, submitted, task_end, task_start

from tidemark.operators import progress as P
from tidemark.sources import generations
from tidemark.sources.event_log import read_events, stream_events
from tidemark.streaming import increments as I


def in_batch(spark, folder, failed_count=True):
    events = read_events(spark, folder, "app-1")
    jobs = P.jobs_from_events(events)
    return rows(P.job_progress(jobs, P.stages_from_events(events, jobs, failed_count)))


@pytest.mark.parametrize("seed", [None, 1])
def test_progress_after_every_batch_equals_the_whole_feed(spark, tmp_path, seed):
    log, folder, store = list(LOG), tmp_path / "log", str(tmp_path / "store")
    folder.mkdir()
    if seed is not None:
        random.Random(seed).shuffle(log)
    n = 3 if seed is None else 2
    size = -(-len(log) // n)
    for k in range(n):
        (folder / f"part-{k}").write_text("\n".join(map(json.dumps, log[k * size : (k + 1) * size])))
        feed = stream_events(spark, str(folder), "app-1")
        I.track(feed, store, str(tmp_path / "checkpoint"), every=2).awaitTermination()
        assert rows(I.tracked_progress(spark, store)) == in_batch(spark, str(folder))
    if seed is None:
        return
    assert rows(P.job_progress(*I.tracked_facts(spark, store, failed_count=False))) == in_batch(spark, str(folder), False)


def batches(spark, tmp_path, store, parts):
    for k, part in enumerate(parts):
        (tmp_path / f"part-{k}").write_text("\n".join(map(json.dumps, part)))
        I.add_batch(read_events(spark, str(tmp_path / f"part-{k}"), "app-1"), store, k)


def test_old_events_stay_unread_unless_a_late_job_splits_a_stage(spark, tmp_path):
    store = str(tmp_path / "store")
    first = [job_start(1, [1, 2], 10), submitted(1, 4, 11), *(task_start(1, t, 12 + 10 * t) for t in range(4)), submitted(2, 1, 12)]
    second = [*(task_end(1, t, 12 + 10 * t, 90) for t in range(4)), task_start(2, 9, 13), completed(2, 12, 14)]
    batches(spark, tmp_path, store, [first, second])
    jobs, stages = I.tracked_facts(spark, store)
    assert not any("/rows/" in f for f in stages.inputFiles())
    assert rows(stages, "stage_id", "tasks_complete") == [(1, 4), (2, 0)]
    # A job whose start arrives last had started between two tasks of stage 1, which it lists too.
    parts = [first, second, [job_start(2, [1], 25)]]
    batches(spark, tmp_path, store, parts)
    found = I.tracked_facts(spark, store)[1]
    assert rows(found, "job_id", "stage_id", "tasks_started", "tasks_complete") == [(1, 1, 2, 2), (1, 2, 1, 0), (2, 1, 2, 2)]
    # A batch that runs twice changes nothing, nor does compaction.
    batches(spark, tmp_path, store, parts)
    before = rows(I.tracked_progress(spark, store))
    I.compact(spark, store, 1)
    assert rows(I.tracked_progress(spark, store)) == before
    I.compact(spark, store, 2)
    assert rows(I.tracked_progress(spark, store)) == before
    assert generations.current(spark, f"{store}/parts") == [f"{store}/parts/gen=2"]


def test_an_empty_store_and_unfinished_folders(spark, tmp_path):
    store = str(tmp_path / "store")
    assert I.tracked_progress(spark, store).count() == 0
    batches(spark, tmp_path, store, [[job_start(1, [1], 10)], [submitted(1, 2, 11)]])
    (Path(store) / "parts" / "batch=1" / "_SUCCESS").unlink()
    assert generations.current(spark, f"{store}/parts") == [f"{store}/parts/batch=0"]


def test_generations_keep_few_folders(spark, tmp_path):
    table = str(tmp_path / "table")
    for n in range(20):
        generations.write(spark.range(n, n + 1).coalesce(1), table, "batch", n)
        if n % 4 == 3:
            generations.write(generations.read(spark, table, "id long", n).coalesce(1), table, "gen", n)
            generations.forget(spark, table, n)
        assert rows(generations.read(spark, table, "id long")) == sorted([(i,) for i in range(n + 1)], key=str)
    assert len(list(Path(table).iterdir())) <= 8


def test_a_batch_is_not_cached(spark, tmp_path, monkeypatch):
    def refuse(*_):
        raise AssertionError("a cached batch takes more disk than its sums")

    monkeypatch.setattr(type(spark.range(1)), "persist", refuse)
    store = str(tmp_path / "store")
    batches(spark, tmp_path, store, [[job_start(1, [1], 10), submitted(1, 2, 11)]])
    assert I.tracked_progress(spark, store).count() == 1


def test_parts_meet_their_listings_in_one_shuffle(spark, tmp_path, monkeypatch):
    """Each end of a part was joined to the listings by a join of its own."""
    store = str(tmp_path / "store")
    batches(spark, tmp_path, store, [[job_start(1, [1, 2], 10), submitted(1, 2, 11), task_start(1, 1, 12)], [task_end(1, 1, 12, 30), job_start(2, [1], 40)]])

    def refuse(*_, **__):
        raise AssertionError("parts go through a join")

    monkeypatch.setattr(I.asof, "asof_join", refuse)
    found = I.tracked_facts(spark, store)[1]
    assert rows(found, "job_id", "stage_id", "tasks_started", "tasks_complete") == [(1, 1, 1, 1), (1, 2, 0, 0), (2, 1, 0, 0)]


@pytest.mark.parametrize("few", [0, 100])
def test_doubtful_stages_few_and_many(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(I, "FEW_DOUBTFUL", few)
    log = [task_start(s, t, 10 * t) for s in range(4) for t in range(6)] + [task_end(s, t, 10 * t, 99, t % 2 == 0) for s in range(4) for t in range(5)]
    late = [job_start(1, [0, 1, 2], 20), job_start(2, [1, 2], 35), job_start(None, [2], 45), job_start(4, [3, None], 100)]
    store = str(tmp_path / "store")
    batches(spark, tmp_path, store, [log, late])
    for failed_count in (True, False):
        found = I.tracked_facts(spark, store, failed_count)[1]
        assert rows(P.job_progress(I.known_jobs(spark, store), found)) == in_batch_of(spark, [str(tmp_path / f"part-{k}") for k in range(2)], failed_count)


def in_batch_of(spark, paths, failed_count):
    events = read_events(spark, paths[0], "app-1").unionByName(read_events(spark, paths[1], "app-1"))
    jobs = P.jobs_from_events(events)
    return rows(P.job_progress(jobs, P.stages_from_events(events, jobs, failed_count)))
