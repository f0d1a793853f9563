"""Running logs as a stream: grow, roll, rename, restart, any place of a slice's end."""

import gzip
import io
import json
import random

import pyarrow as pa
import pytest
from conftest import rows
from test_progress import LOG

from tidemark.operators import progress as P
from tidemark.plans import table_queries
from tidemark.sources import live_logs as L
from tidemark.sources.event_log import follow_logs, stream_events
from tidemark.streaming import events as S


def line(job):
    return json.dumps({"Event": P.JOB_START, "Job ID": job}) + "\n"


@pytest.fixture
def feed(spark, tmp_path):
    """The folder of logs, and a run of the ingest that goes on where the last one stopped."""
    logs = tmp_path / "logs"
    logs.mkdir()

    def ingested(**options):
        out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
        S.ingest(follow_logs(spark, str(logs), **options), out, checkpoint).awaitTermination()
        return rows(spark.read.parquet(out), "app_id", "`Job ID`")

    return logs, ingested


def test_each_line_once_while_logs_grow_roll_and_are_renamed(feed):
    logs, ingested = feed
    running, rolled = logs / "app-1.inprogress", logs / "eventlog_v2_app-2"
    rolled.mkdir()
    (rolled / "appstatus_app-2.inprogress").touch()
    running.write_text(line(1) + line(2) + line(3)[:9])
    (rolled / "events_1_app-2").write_text(line(10))
    want = [("app-1", 1), ("app-1", 2), ("app-2", 10)]
    assert ingested() == want
    assert ingested() == want
    # The cut line is completed, the other application rolls its log.
    running.write_text(line(1) + line(2) + line(3) + line(4))
    (rolled / "events_2_app-2").write_text(line(11))
    want = sorted([*want, ("app-1", 3), ("app-1", 4), ("app-2", 11)], key=str)
    assert ingested() == want
    # One application ends, with a last event; its log is renamed. The other rolls on.
    with running.open("a") as log:
        log.write(line(5))
    running.rename(logs / "app-1")
    (rolled / "events_2_app-2").write_text(line(11) + line(12))
    (rolled / "events_3_app-2").write_text(line(13))
    (rolled / "events_1_app-2.compact").write_text(line(10))
    (rolled / "appstatus_app-2.inprogress").rename(rolled / "appstatus_app-2")
    (logs / "app-3").write_text("no event\n{}\n" + line(20))
    want = sorted([*want, ("app-1", 5), ("app-2", 12), ("app-2", 13), ("app-3", 20)], key=str)
    assert ingested() == want
    # An old log is removed.
    (logs / "app-1").unlink()
    assert ingested() == want


def test_small_slices_and_one_running_query(spark, tmp_path):
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    logs.mkdir()
    log = logs / "app-1.inprogress"
    log.touch()
    feed = follow_logs(spark, str(logs), slice_bytes=50)
    query = S.ingest(feed, out, str(tmp_path / "checkpoint"), trigger={"processingTime": "0 seconds"})
    text = "".join(line(n) for n in range(40))
    cuts = sorted(random.Random(1).sample(range(len(text)), 5))
    try:
        for low, high in zip([0, *cuts], [*cuts, len(text)], strict=True):
            with log.open("a") as file:
                file.write(text[low:high])
            query.processAllAvailable()
        log.rename(logs / "app-1")
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r[0] for r in spark.read.parquet(out).select("`Job ID`").collect()) == list(range(40))


def test_progress_of_followed_logs_equals_batch(spark, feed, tmp_path):
    logs, ingested = feed
    text = "".join(json.dumps(e) + "\n" for e in LOG)
    for cut in (len(text) // 3, len(text) // 2, len(text)):
        (logs / "app-1.inprogress").write_text(text[:cut])
        ingested(slice_bytes=97)
    found = S.progress_of_feed(spark, str(tmp_path / "out"))
    whole = spark.read.schema(spark.read.json(str(logs)).schema).json(str(logs))
    assert whole.count() == spark.read.parquet(str(tmp_path / "out")).count() == len(LOG)
    (logs / "app-1.inprogress").rename(logs / "app-1")
    S.ingest(stream_events(spark, str(logs)), str(tmp_path / "once"), str(tmp_path / "check-2")).awaitTermination()
    assert rows(found) == rows(S.progress_of_feed(spark, str(tmp_path / "once")))


def test_files_in_progress_wait_for_their_end(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def ingested():
        S.ingest(stream_events(spark, str(logs)), out, checkpoint).awaitTermination()
        return rows(spark.read.parquet(out), "`Job ID`")

    (logs / "app-0").write_text(line(0))
    (logs / "app-1.inprogress").write_text(line(1))
    assert ingested() == [(0,)]
    (logs / "app-1.inprogress").write_text(line(1) + line(2))
    (logs / "app-1.inprogress").rename(logs / "app-1")
    assert ingested() == [(0,), (1,), (2,)]


def test_slices_anywhere_give_each_line_once(monkeypatch):
    rng = random.Random(2)
    for chunk in (1, 7, 1 << 20):
        monkeypatch.setattr(L, "_CHUNK", chunk)
        for _ in range(30):
            whole = [b"x" * rng.choice([0, 1, 5, 70_000 if chunk > 7 else 9]) + str(n).encode() for n in range(rng.randrange(8))]
            data = b"".join(w + b"\n" for w in whole) + b"rest"
            cuts = sorted(rng.choices(range(len(data) + 1), k=rng.randrange(6)))
            file = pa.PythonFile(io.BytesIO(data), mode="r")
            found = [w for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True) for part in L.lines(file, a, b) for w in part]
            assert found == whole


def test_odd_logs_are_refused(tmp_path):
    assert L.sizes(f"file:{tmp_path}/none") == {}
    (tmp_path / "app-1.zstd").touch()
    with pytest.raises(ValueError, match="compressed"):
        L.sizes(f"file:{tmp_path}")
    with pytest.raises(ValueError, match="now has 5"):
        L.slices({"a": 9}, {"a": 5}, 10)
    assert [(s.log, s.start, s.end) for s in L.slices({"a": 3, "gone": 4}, {"a": 25, "b": 2}, 10)] == [("a", 3, 13), ("a", 13, 23), ("a", 23, 25), ("b", 0, 2)]


@pytest.mark.parametrize("name", ["chunks", "members"])
def test_packed_logs_cut_anywhere_give_each_line_once(monkeypatch, name):
    rng = random.Random(3)
    for chunk in (1, 7, 1 << 20):
        monkeypatch.setattr(L, "_CHUNK", chunk)
        monkeypatch.setattr(L, "_PACKED_CHUNK", max(3, chunk // 2))
        for _ in range(20):
            whole = [b"x" * rng.choice([0, 1, 5, 700]) + str(n).encode() for n in range(rng.randrange(9))]
            text = [w + b"\n" for w in whole] + [b"rest"]
            data = b"".join(gzip.compress(t) for t in text) + b"\0" * 3 if name == "members" else gzip.compress(b"".join(text))
            cuts = sorted(rng.choices(range(len(data) + 1), k=rng.randrange(6)))
            file = pa.PythonFile(io.BytesIO(data), mode="r")
            found = [w for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True) for part in L.packed_lines(file, a, b) for w in part]
            assert found == whole


def test_packed_logs_are_followed(feed):
    logs, ingested = feed
    data = gzip.compress((line(1) + line(2) + line(3)).encode())
    (logs / "app-1.gz.inprogress").write_bytes(data[:-9])
    (logs / "app-2.gz").write_bytes(gzip.compress(line(9).encode()))
    ingested()
    (logs / "app-1.gz.inprogress").write_bytes(data + gzip.compress(line(4).encode()))
    (logs / "app-1.gz.inprogress").rename(logs / "app-1.gz")
    assert ingested(slice_bytes=5) == [("app-1", 1), ("app-1", 2), ("app-1", 3), ("app-1", 4), ("app-2", 9)]


def test_query_of_followed_logs_writes_them_packed(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(table_queries, "follow_logs", lambda spark, path, app: seen.append(path) or follow_logs(spark, path, app))
    assert table_queries.followed_log_progress(spark, "/root/testdata/sf0.001").count() > 0
    assert len(seen) == 2 and all(name.endswith(".gz") for name in L.sizes(f"file:{seen[0]}"))


def test_a_line_is_parsed_once(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "app-1").write_text(line(1))
    writer = follow_logs(spark, str(tmp_path / "logs")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c"))
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    assert query._jsq.explainInternal(False).count("from_json") == 1


def test_texts_of_lines():
    whole = [b"a", b"", "é".encode(), b"\xffb"]
    for part in (whole, whole[:3], []):
        assert L._texts(part).to_pylist() == [line.decode("utf-8", "replace") for line in part]
        assert L._texts(part).type == pa.string()
