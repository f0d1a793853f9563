import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.functions.scalars import fields, has_property, now_millis, progress, property_or_blank, token
from tidemark.operators.history import envelopes, history_events, run_state
from tidemark.plans.jobs import job, job_names, run_job
from tidemark.plans.scripts import failure, load_result, outcome, run_and_save, run_script, run_statement
from tidemark.schemas import ENVELOPE, HISTORY
from tidemark.session import shared_dir
from tidemark.sources.delimited import append_envelopes, append_records
from tidemark.sources.tables import cache_table, dataset, list_tables, raw_dataset, uncache_table


def test_statement_and_scripts(spark):
    assert run_statement(spark, "SELECT 1 AS x").first()[0] == 1
    statements = ["CREATE OR REPLACE TEMP VIEW s1 AS SELECT 'a;b' AS x", "SELECT x FROM s1"]
    assert rows(run_script(spark, statements)) == [("a;b",)]
    text = "CREATE OR REPLACE TEMP VIEW s2 AS SELECT ';' AS x; -- note; note\nSELECT x FROM s2 -- end"
    assert rows(run_script(spark, text)) == [(";",)]
    assert rows(run_script(spark, "SELECT 1; SELECT 2;")) == [(2,)]


@pytest.mark.parametrize("script", ["", "  ;\n", []])
def test_empty_script_is_refused(spark, script):
    with pytest.raises(ValueError, match="empty"):
        run_script(spark, script)


def test_result_is_saved_and_described(spark, tmp_path):
    statements = ["CREATE OR REPLACE TEMP VIEW s3 AS SELECT * FROM range(3)", "SELECT id, array(id) AS a FROM s3"]
    record = run_and_save(spark, statements, str(tmp_path), "h1", {"jobName": "demo"}).first()
    data = json.loads(record["data"])
    assert record["success"] and json.loads(record["options"]) == {"jobName": "demo"}
    assert [c["type"] for c in data["columns"]] == ["bigint", "array<bigint>"]
    assert rows(load_result(spark, data["outputDir"])) == [(0, [0]), (1, [1]), (2, [2])]


def test_statement_without_result_runs_once(spark, tmp_path):
    target = tmp_path / "t"
    run_script(spark, [f"CREATE TABLE once (x INT) USING parquet LOCATION '{target}'"])
    try:
        record = run_and_save(spark, ["INSERT INTO once VALUES (1)"], str(tmp_path), "h2").first()
        data = json.loads(record["data"])
        assert record["success"] and data["result"] == [] and "columns" not in data
        assert spark.table("once").count() == 1
    finally:
        run_script(spark, ["DROP TABLE once"])


def test_commands_with_rows_are_saved(spark, tmp_path):
    spark.range(1).createOrReplaceTempView("shown")
    record = run_and_save(spark, ["SHOW TABLES"], str(tmp_path), "h3").first()
    saved = load_result(spark, json.loads(record["data"])["outputDir"])
    assert ("shown",) in rows(saved, "tableName")


def test_texts_keep_the_rows_of_commands(spark, tmp_path):
    spark.range(1).createOrReplaceTempView("shown")
    texts = [
        ("SHOW TABLES;", "tableName", "shown"),
        ("DESCRIBE shown", "col_name", "id"),
        ("SELECT 1 AS a; -- the tables\nSHOW TABLES", "tableName", "shown"),
        ("SELECT 1 AS a; /* x; y */ SHOW TABLES -- end;", "tableName", "shown"),
        ("SELECT ';' AS `\U0001f600`; DESC shown;", "col_name", "id"),
        ("CREATE OR REPLACE TEMP VIEW shown_2 AS SELECT 'a;b' AS x; SHOW TABLES LIKE 'shown_2'", "tableName", "shown_2"),
    ]
    for n, (text, column, value) in enumerate(texts):
        record = run_and_save(spark, text, str(tmp_path), f"h6-{n}").first()
        saved = load_result(spark, json.loads(record["data"])["outputDir"])
        assert (value,) in rows(saved, column)
    assert "Project" in run_script(spark, "SELECT 1; EXPLAIN SELECT 'a;b' AS x").first()[0]


def test_no_other_statement_passes_for_the_last(spark, tmp_path):
    record = run_and_save(spark, "SELECT 1 AS a; CREATE OR REPLACE TEMP VIEW made AS SELECT 7 AS q;", str(tmp_path), "h8").first()
    assert json.loads(record["data"])["result"] == [] and spark.table("made").first()[0] == 7
    assert rows(run_script(spark, "DECLARE x INT DEFAULT 3; SELECT x + 1 AS y")) == [(4,)]
    assert rows(run_script(spark, "BEGIN SELECT 1; SELECT 4 AS f; END;")) == [(4,)]
    assert rows(run_script(spark, "SELECT 'it''s; x' AS s; -- end")) == [("it's; x",)]
    with pytest.raises(ValueError, match="empty"):
        run_script(spark, "/* nothing */")


def test_failure_is_recorded(spark, tmp_path):
    record = run_and_save(spark, ["SELECT 1", "SELECT nothing FROM nowhere"], str(tmp_path), "h4").first()
    data = json.loads(record["data"])
    assert not record["success"] and "nowhere" in data["error"]
    assert len(data["trace"]) > 1 and not any("\t" in line or "\n" in line for line in data["trace"])
    # Found only while rows are computed.
    record = run_and_save(spark, ["SELECT raise_error('late') AS x"], str(tmp_path), "h5").first()
    assert not record["success"] and "late" in json.loads(record["data"])["error"]


def test_trace_lines_replace_tabs(spark):
    record = failure(spark, "h", ValueError("a\tb\nc")).first()
    assert json.loads(record["data"])["trace"][-3:] == ["ValueError: a    b", "c", ""]


def test_outcomes_are_appended(spark, tmp_path):
    path = str(tmp_path / "outcomes")
    for n in range(2):
        append_envelopes(outcome(spark, f"h{n}", True, {"n": n}), path)
    back = spark.read.schema(ENVELOPE).json(path)
    assert rows(back) == [("h0", True, '{"n": 0}', "{}"), ("h1", True, '{"n": 1}', "{}")]


def test_envelopes_of_many_runs(spark):
    runs = spark.range(2).withColumn("lines", F.array(F.lit("x")))
    found = envelopes(runs, F.col("id"), F.col("id") == 0, F.struct("id", "lines"), F.create_map(F.lit("k"), "id"))
    assert rows(found) == [("0", True, '{"id":0,"lines":["x"]}', '{"k":0}'), ("1", False, '{"id":1,"lines":["x"]}', '{"k":1}')]


def test_history(spark, tmp_path):
    path = str(tmp_path / "history")
    runs = spark.range(3)
    common = {"account": F.lit("acme"), "user": F.lit("ann"), "handle": F.col("id")}
    append_records(history_events(runs, "job_start", ts=F.timestamp_seconds("id"), **common), path)
    append_records(history_events(runs.where("id < 2"), "job_complete", job_type=F.lit("sql"), **common), path)
    append_records(history_events(runs.where("id = 1"), "job_start", ts=F.lit("2999-01-01"), **common), path)
    history = spark.read.parquet(path)
    assert [f"{n} {t}" for n, t in history.dtypes] == [f.strip() for f in HISTORY.split(",")]
    assert rows(run_state(history)) == [("0", False), ("1", True), ("2", True)]


def test_completion_without_start_is_not_running(spark):
    history = spark.createDataFrame([("a", "job_complete", 1), ("b", "other", 1)], "job_handle string, event string, ts int")
    assert rows(run_state(history)) == [("a", False)]


@job("numbers")
def numbers(spark):
    return spark.range(3)


@job("counted")
def counted(spark, options):
    return spark.range(options.get("n", 1))


def test_jobs(spark):
    assert job_names() == ["counted", "numbers"]
    assert run_job(spark, "numbers", {"n": 9}).count() == 3
    assert run_job(spark, "counted", {"n": 9}).count() == 9
    assert run_job(spark, "counted").count() == 1


def test_dataset_and_row_cap(spark):
    spark.range(10).createOrReplaceTempView("ten")
    assert dataset(spark, "ten").count() == 10
    assert dataset(spark, "ten", 4).count() == 4


def test_list_and_cache(spark):
    spark.range(1).createOrReplaceTempView("cached_once")
    assert ("cached_once",) in rows(list_tables(spark), "tableName")
    cache_table(spark, "cached_once")
    assert spark.catalog.isCached("cached_once")
    uncache_table(spark, "cached_once")
    assert not spark.catalog.isCached("cached_once")


def test_raw_dataset(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "raw" / "b.txt").write_text("three\n")
    assert rows(raw_dataset(spark, str(tmp_path), "raw")) == [("one",), ("three",), ("two",)]
    assert raw_dataset(spark, str(tmp_path) + "/", "raw", 5).rdd.getNumPartitions() == 5


def test_shared_dir_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    path = shared_dir(spark, "x")
    assert path != shared_dir(spark, "x")
    assert root is None or path.startswith(root)


def test_small_expressions(spark):
    row = spark.sql("SELECT map('k', 'v') AS m, ' a  b\\tc ' AS t, '  ' AS blank, 'x\\ty' AS line").select(
        property_or_blank(F.col("m"), "k"), property_or_blank(F.col("m"), "x"),
        has_property(F.col("m"), "k"), has_property(F.lit(None).cast("map<string,string>"), "k"),
        token(F.col("t"), 0), token(F.col("t"), 1), token(F.col("t"), 2), token(F.col("t"), 3),
        token(F.col("blank"), 0), token(F.col("blank"), 1), fields(F.col("line")),
        progress(F.lit(1), F.lit(4)), progress(F.lit(0), F.lit(0)), now_millis() > 1_700_000_000_000,
    ).first()
    assert tuple(row) == ("v", "", True, False, "a", "b", "c", None, None, None, ["x", "y"], 0.25, 1.0, True)
