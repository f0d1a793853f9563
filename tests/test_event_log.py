"""The progress operators over logs that Spark itself wrote."""

import subprocess
import sys

import pytest
from conftest import rows

from tidemark.operators import progress as P
from tidemark.sources.event_log import read_events, write_events

APP = """
import sys
from pyspark.sql import SparkSession, functions as F
folder, rolling = sys.argv[1:]
spark = (SparkSession.builder.master("local[2]").appName("logged").config("spark.ui.enabled", "false")
    .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", "file://" + folder)
    .config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", rolling)
    .config("spark.sql.adaptive.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate())
sc = spark.sparkContext
sc.setJobGroup("good", "works")
sc.setLocalProperty("spark.job.type", "sql")
sc.setLocalProperty("spark.job.name", "sum up")
spark.range(0, 100, 1, 4).groupBy((F.col("id") % 5).alias("k")).count().collect()
sc.setJobGroup("bad", "fails")
sc.setLocalProperty("spark.job.type", None)
sc.setLocalProperty("spark.job.name", None)
try:
    spark.range(0, 10, 1, 2).select(F.assert_true(F.col("id") < 3)).collect()
except Exception:
    pass
spark.stop()
"""


def test_folder_of_single_rolled_and_running_logs(spark, tmp_path):
    def line(job):
        return f'{{"Event":"{P.JOB_START}","Job ID":{job}}}\n'

    logs = tmp_path / "logs"
    rolled = logs / "eventlog_v2_app-2"
    rolled.mkdir(parents=True)
    (logs / "app-1").write_text(line(1))
    (rolled / "appstatus_app-2").touch()
    (rolled / "events_1_app-2").write_text(line(2) + line(3))
    (rolled / "events_2_app-2.inprogress").write_text(line(4))
    (logs / "app-3.inprogress").write_text(line(5))
    want = [("app-1", 1), ("app-2", 2), ("app-2", 3), ("app-2", 4), ("app-3", 5)]
    assert rows(read_events(spark, str(logs)), "app_id", "`Job ID`") == want
    # The application has ended: its file loses the ending, its id stays.
    (logs / "app-3.inprogress").rename(logs / "app-3")
    assert rows(read_events(spark, str(logs)), "app_id", "`Job ID`") == want


@pytest.mark.parametrize("rolling", ["false", "true"])
def test_log_of_a_real_application(spark, tmp_path, rolling):
    folder = tmp_path / "logs"
    folder.mkdir()
    run = [sys.executable, "-c", APP, str(folder), rolling]
    subprocess.run(run, check=True, timeout=120, capture_output=True)
    files = [p for p in folder.rglob("*") if p.is_file() and not p.name.startswith((".", "appstatus"))]
    assert len(files) == 1
    store = str(tmp_path / "store")
    write_events(read_events(spark, str(files[0])), store)
    events = spark.read.parquet(store)
    jobs, stages = P.facts_from_events(events)
    assert {r["app_id"][:6] for r in jobs.collect()} == {"local-"}
    assert rows(P.app_starts(events), "app_name") == [("logged",)]
    progress = P.job_progress(jobs, stages)
    good = progress.where("handle = 'good' AND type = 'sql' AND name = 'sum up'")
    assert rows(good, "complete", "failed", "stage_progress") == [(True, False, 1.0)]
    assert rows(progress.where("handle = 'bad'"), "type", "name", "complete", "failed") == [("", "", True, True)]
    job = good.first()["job_id"]
    tasks = stages.where(f"job_id = {job}").orderBy("stage_id")
    assert [r["num_tasks"] for r in tasks.collect()] == [4, 3]
    assert [r["tasks_complete"] for r in tasks.collect()] == [4, 3]
    assert P.running_count(jobs).first()[0] == 0
    assert P.tasks_from_events(events).where("duration IS NULL OR duration < 0").count() == 0
