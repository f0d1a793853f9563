import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import asof
from tidemark.operators.asof import along, asof_join, crowded, hot_keys, with_parts


@pytest.fixture(autouse=True)
def small_keys_may_be_hot(monkeypatch):
    monkeypatch.setattr(asof, "HOT_ROWS", 20)


def brute_force(left, right):
    """(key, time, id) joined to the (key, time, id) that is latest and not later."""
    found = []
    for key, time, ident in left:
        if key is None or time is None:
            continue
        starts = [(t, i) for k, t, i in right if k == key and t is not None and t <= time]
        if starts:
            start, owner = max(starts)
            found.append((key, time, ident, start, owner))
    return sorted(found)


def sample(seed, n_left, n_right, span, hot_share):
    rng = random.Random(seed)

    def key():
        return 0 if rng.random() < hot_share else rng.randrange(1, 30)

    left = [(key(), rng.randrange(span), i) for i in range(n_left)]
    right = [(key(), rng.randrange(span), i) for i in range(n_right)]
    left += [(None, 5, -1), (0, None, -2), (99, 5, -3)]
    right += [(None, 1, -1), (0, None, -2)]
    return left, right


def frames(spark, left, right):
    return (
        spark.createDataFrame(left, "k long, t long, id long"),
        spark.createDataFrame(right, "k long, start long, owner long"),
    )


@pytest.mark.parametrize("span", [8, 1000])
@pytest.mark.parametrize("hot_share", [0.0, 0.4, 1.0])
def test_join_equals_brute_force(spark, span, hot_share):
    left, right = sample(1, 600, 400, span, hot_share)
    joined = asof_join(*frames(spark, left, right), ["k"], "t", "start", "owner")
    assert joined.columns == ["k", "t", "id", "start", "owner"]
    assert rows(joined) == [tuple(x) for x in sorted(brute_force(left, right), key=lambda t: [(False, str(v)) for v in t])]


@pytest.mark.parametrize("part_rows", [1, 7, 10_000])
def test_any_number_of_parts_agrees(spark, part_rows):
    left, right = sample(2, 500, 80, 50, 0.5)
    joined = asof_join(*frames(spark, left, right), ["k"], "t", "start", "owner", part_rows=part_rows)
    assert sorted(tuple(r) for r in joined.collect()) == brute_force(left, right)


@pytest.mark.parametrize("part_rows", [4, 10_000])
def test_left_join_keeps_rows_without_an_owner(spark, part_rows):
    left, right = sample(5, 300, 40, 60, 0.5)
    joined = asof_join(*frames(spark, left, right), ["k"], "t", "start", "owner", how="left", part_rows=part_rows)
    owned = brute_force(left, right)
    missing = [(*x, None, None) for x in left if x not in [o[:3] for o in owned]]
    assert rows(joined) == sorted(owned + missing, key=lambda t: [(x is None, str(x)) for x in t])


def test_null_ties_and_repeated_rows(spark):
    left = spark.createDataFrame([(1, 5, 1)] * 3, "k long, t long, id long")
    right = spark.createDataFrame([(1, 4, None), (1, 2, 7), (1, 2, 7)], "k long, start long, owner long")
    assert rows(asof_join(left, right, ["k"], "t", "start", "owner")) == [(1, 5, 1, 4, None)] * 3
    assert rows(asof_join(left, right.where("start = 2"), ["k"], "t", "start", "owner")) == [(1, 5, 1, 2, 7)] * 3
    assert asof_join(left.where("false"), right, ["k"], "t", "start").count() == 0
    assert asof_join(left, right.where("false"), ["k"], "t", "start").count() == 0


def test_hot_keys_are_found_and_bounded(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("k"))
    assert [tuple(r) for r in hot_keys(df, ["k"], 125).collect()] == [(0, 400, 4)]
    assert hot_keys(df, ["k"], 400).isEmpty()
    assert hot_keys(df.where("false"), ["k"], 8).isEmpty()


def test_parts_of_a_hot_key_are_even(spark, monkeypatch):
    monkeypatch.setattr(asof, "CUT_SAMPLE", 50)
    times = spark.range(9000).select((F.col("id") % 3 * F.col("id")).alias("k"), (F.col("id") * F.col("id")).alias("_time"))
    sizes = with_parts(times, ["k"], 750).where("k = 0").groupBy("_part").count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 1.3 * 3000 / 4


@pytest.mark.parametrize("per_part", [1, 5])
def test_sampled_cuts_change_no_result(spark, monkeypatch, per_part):
    left, right = sample(4, 2000, 1000, 500, 0.6)
    monkeypatch.setattr(asof, "CUT_SAMPLE", per_part)
    joined = asof_join(*frames(spark, left, right), ["k"], "t", "start", "owner", part_rows=300)
    assert sorted(tuple(r) for r in joined.collect()) == brute_force(left, right)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "double", "string"])
def test_other_time_types(spark, kind):
    day = "timestamp_ntz'2024-03-30 22:00:00' + make_dt_interval(0, id % 50, 0, 0.25)"
    time = "CAST(id % 50 AS double)" if kind == "double" else f"CAST({day} AS {kind})"
    left = spark.range(300).selectExpr("0 AS k", f"{time} AS t", "id")
    right = spark.range(0, 300, 7).selectExpr("0 AS k", f"{time} AS start", "id AS owner")
    hot = asof_join(left, right, ["k"], "t", "start", "owner", part_rows=9)
    plain = asof_join(left, right, ["k"], "t", "start", "owner", part_rows=1000)
    assert rows(hot) == rows(plain) and hot.count() == 300


def test_a_hot_instant_is_spread_over_tasks(spark):
    """All rows of a hot key at one time: one instant until the last join, which Spark splits."""
    left = spark.range(0, 200_000, 1, 8).selectExpr("IF(id % 3 = 0, 0, id) AS k", "IF(id % 3 = 0, 5, id) AS t", "sha2(CAST(id AS string), 256) AS c")
    right = spark.range(0, 200_000, 2, 8).selectExpr("id AS k", "4 AS start", "id AS owner")
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        joined = asof_join(left, right, ["k"], "t", "start", "owner")
        tasks = joined.groupBy(F.spark_partition_id().alias("task")).agg(F.count_if(F.col("k") == 0).alias("hot"), F.max("c"))
        hot = [r["hot"] for r in tasks.collect() if r["hot"]]
        assert sum(hot) == 66_667 and len(hot) > 3 and max(hot) < 66_667 / 3
    finally:
        for key in conf:
            spark.conf.unset(key)


def test_nothing_runs_until_the_rows_are_wanted(spark):
    tracker = spark.sparkContext.statusTracker()
    group = "as-of plan"
    spark.sparkContext.setJobGroup(group, group)
    try:
        asof_join(*frames(spark, *sample(1, 50, 50, 8, 0.4)), ["k"], "t", "start", "owner")
        assert not tracker.getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_keys_with_few_right_rows_are_joined_without_windows(spark):
    left, right = sample(6, 300, 40, 50, 0.0)
    joined = asof_join(*frames(spark, left, right), ["k"], "t", "start", "owner")
    assert sorted(tuple(r) for r in joined.collect()) == brute_force(left, right)
    ran = joined._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in ran and "Window" not in ran


@pytest.mark.parametrize("how", ["inner", "left"])
def test_keys_with_few_and_with_many_right_rows_together(spark, monkeypatch, how):
    monkeypatch.setattr(asof, "FEW_ROWS", 15)
    monkeypatch.setattr(asof, "BUSY_HASHES", 11)
    left, right = sample(7, 400, 400, 60, 0.2)
    joined = asof_join(*frames(spark, left, right), ["k"], "t", "start", "owner", how=how, part_rows=30)
    owned = brute_force(left, right)
    met = {o[:3] for o in owned}
    missing = [(*x, None, None) for x in left if x not in met] if how == "left" else []
    assert rows(joined) == sorted(owned + missing, key=lambda t: [(x is None, str(x)) for x in t])


def test_rows_along_equal_brute_force(spark):
    left, right = sample(8, 300, 60, 40, 0.3)
    found = along(*frames(spark, left, right), ["k"], "t", "start", "owner")
    met = found.where("NOT _right AND _at IS NOT NULL").selectExpr("k", "t", "id", "_at.time AS start", "_at.tie AS owner")
    assert sorted(tuple(r) for r in met.collect()) == brute_force(left, right)
    assert found.where("NOT _right").count() == len(left) and rows(found.where("_right"), "k", "start", "owner") == rows(frames(spark, left, right)[1])


def test_crowded_keys_are_found_by_a_share_of_their_rows(spark):
    left = spark.range(9000).selectExpr("IF(id < 4000, 0, id) AS k", "id AS t")
    right = spark.range(3000).selectExpr("IF(id < 2000, 1, id) AS k", "id AS t")
    assert rows(crowded([left, right], ["k"], 1500)) == [(0,), (1,)]
    assert rows(crowded([left, right], ["k"], 2500)) == [(0,)]
    assert crowded([left, right], ["k"], 5000).isEmpty()
