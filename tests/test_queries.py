"""Every registered query against DuckDB, and the shape of the important plans."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from tidemark.plans import table_queries
from tidemark.plans.oracles import ORACLES
from tidemark.plans.table_queries import QUERIES
from tidemark.session import checkpointed
from tidemark.sources.event_log import read_events

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        table = name.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{name}'")
    yield connection
    connection.close()


def in_order(tuples):
    return sorted(tuples, key=lambda t: [(x is None, str(x)) for x in t])


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_duckdb(spark, duck, name):
    found = driver.queries()[name](spark, SF)
    expected = duck.sql(driver.oracle_sql()[name])
    names = sorted(found.columns)
    assert names == sorted(expected.columns)
    types = dict(zip(expected.columns, map(str, expected.types)))
    assert {c: TYPES[t] for c, t in found.dtypes} == types
    places = [expected.columns.index(c) for c in names]
    rows = in_order(tuple(r) for r in found.select(*names).collect())
    assert rows == in_order(tuple(r[i] for i in places) for r in expected.fetchall())
    assert rows
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert operator not in plan(found)


def test_no_stage_contradicts_itself(spark):
    stages = driver.queries()["feed_stages"](spark, SF)
    assert stages.where("tasks_in_progress < 0 OR (complete AND NOT submitted)").isEmpty()


def test_handles_show_their_latest_job(spark):
    shown = driver.queries()["progress_by_handle"](spark, SF).select("handle", "job_id")
    latest = driver.queries()["latest_job_per_handle"](spark, SF).select("handle", "job_id")
    assert shown.exceptAll(latest).isEmpty()
    both = driver.queries()["progress_by_handle"](spark, SF).where("complete AND running")
    assert both.isEmpty()


def test_entry(spark):
    assert driver.entry(spark).columns == ["hashtag", "sentiment", "total"]


def test_texts_are_counted_before_the_join(spark):
    text = plan(driver.queries()["keyword_sentiment_counts"](spark, SF))
    join = text.index("Join")
    assert "partial_count" in text[join:] and "explode" in text[join:]
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    assert "size(split" not in text


def test_top_k_is_cut_before_the_shuffle(spark):
    text = plan(driver.queries()["top_keywords_per_source"](spark, SF))
    assert "Partial" in text[text.index("WindowGroupLimit"):]
    assert "TakeOrderedAndProject" in plan(driver.queries()["top_keywords"](spark, SF))


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(driver.queries()["history_running"](spark, SF))
    assert "In(event_type, [purchase,signup])" in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in text


def test_texts_are_split_once_for_ranks_and_positions(spark):
    for name in ("many_keywords_per_source", "keyword_text_positions"):
        assert "explode" not in plan(driver.queries()[name](spark, SF))


def test_logs_of_the_feed_are_packed(spark):
    path = table_queries._feed_files(spark, SF)
    files = [f for f in os.listdir(path) if not f.startswith((".", "_"))]
    assert files and all(f.endswith(".json.lz4") for f in files)
    assert read_events(spark, path, "a").count() == table_queries._feed(spark, SF).count()


def test_kept_rows_are_parquet(spark):
    kept = checkpointed(spark.range(5))
    assert kept.count() == 5 and all(f.endswith(".parquet") for f in kept.inputFiles())
