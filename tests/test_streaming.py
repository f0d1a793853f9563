import json
from pathlib import Path

from conftest import rows
from test_progress import LOG, STAGES, write_log

from tidemark.operators import progress as P
from tidemark.sources.event_log import read_events, stream_events
from tidemark.streaming import events as S


def paths(tmp_path):
    return str(tmp_path / "out"), str(tmp_path / "checkpoint")


def test_ingest_in_steps_equals_batch(spark, tmp_path):
    out, checkpoint = paths(tmp_path)
    cut = len(LOG) // 2
    for step, part in enumerate((LOG[cut:], LOG[:cut])):
        folder = write_log(tmp_path / "log", part, f"part-{step}", shuffle=step)
        S.ingest(stream_events(spark, folder, "app-1"), out, checkpoint).awaitTermination()
    # Nothing new: a third run adds nothing.
    S.ingest(stream_events(spark, folder, "app-1"), out, checkpoint).awaitTermination()
    stored = spark.read.parquet(out)
    assert stored.count() == len(LOG)
    jobs = P.jobs_from_events(stored)
    assert rows(P.stages_from_events(stored, jobs).drop("app_id")) == STAGES
    batch = read_events(spark, folder, "app-1")
    jobs = P.jobs_from_events(batch)
    expected = rows(P.job_progress(jobs, P.stages_from_events(batch, jobs)))
    assert rows(S.progress_of_feed(spark, out)) == expected
    # Four jobs run, so one of the three completed ones is kept among five.
    assert rows(S.progress_of_feed(spark, out, keep=5), "job_id") == [(2,), (3,), (4,), (5,), (6,)]


def test_event_counts_grow(spark, tmp_path):
    out, checkpoint = paths(tmp_path)
    totals = []
    for step in range(3):
        folder = write_log(tmp_path / "log", LOG, f"part-{step}")
        feed = stream_events(spark, folder, "app-1", files_per_trigger=1)
        S.event_counts(feed, out, checkpoint).awaitTermination()
        counts = {r["Event"]: r["total"] for r in S.latest_result(spark, out).collect()}
        totals.append((counts[P.JOB_START], sum(counts.values())))
    starts = sum(e["Event"] == P.JOB_START for e in LOG)
    assert totals == [(starts * n, len(LOG) * n) for n in (1, 2, 3)]


def test_stage_states_by_update(spark, tmp_path):
    out, checkpoint = paths(tmp_path)
    (tmp_path / "log").mkdir()
    for step in range(4):
        lines = [json.dumps(e) for e in LOG[step::4]]
        (tmp_path / "log" / f"p{step}").write_text("\n".join(lines))
        feed = stream_events(spark, str(tmp_path / "log"), "app-1")
        S.stage_states(feed, out, checkpoint).awaitTermination()
    found = S.latest_rows(spark, out, ["app_id", "stage_id"])
    by_stage = {r["stage_id"]: (r["num_tasks"], r["tasks_started"], r["tasks_complete"], r["complete"]) for r in found.collect()}
    assert by_stage[0] == (1, 1, 1, True)
    assert by_stage[2] == (2, 3, 2, False)
    assert by_stage[3] == (4, 3, 2, False)
    assert by_stage[6] == (3, 2, 2, True)
    assert found.count() == len(by_stage)


def test_results_of_many_batches_stay_few_folders(spark, tmp_path):
    """Also a batch that runs again, as after a crash before its commit, changes nothing."""
    logs = tmp_path / "log"
    logs.mkdir()
    for step in range(14):
        lines = [json.dumps(e) for e in LOG[step::14]]
        (logs / f"p{step}").write_text("\n".join(lines))
    feed = stream_events(spark, str(logs), "app-1", files_per_trigger=1)
    found = {}
    for name, start in (("counts", S.event_counts), ("states", S.stage_states)):
        out, checkpoint = str(tmp_path / name), tmp_path / f"{name}-checkpoint"
        options = {"every": 4} if name == "states" else {}
        start(feed, out, str(checkpoint), **options).awaitTermination()

        def shown():
            return rows(S.latest_result(spark, out) if name == "counts" else S.latest_rows(spark, out, ["app_id", "stage_id"]))

        found[name] = shown()
        assert len(list(Path(out).iterdir())) <= (2 if name == "counts" else 9)
        last = max(int(p.name) for p in (checkpoint / "commits").iterdir() if p.name.isdigit())
        for file in (checkpoint / "commits").glob(f"*{last}*"):
            file.unlink()
        start(feed, out, str(checkpoint), **options).awaitTermination()
        assert shown() == found[name]
    counts = read_events(spark, str(logs), "app-1").groupBy("Event").count()
    assert found["counts"] == rows(counts)
    whole = str(tmp_path / "whole"), str(tmp_path / "whole-checkpoint")
    S.stage_states(stream_events(spark, str(logs), "app-1"), *whole).awaitTermination()
    assert found["states"] == rows(S.latest_rows(spark, whole[0], ["app_id", "stage_id"]))
