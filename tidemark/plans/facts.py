"""The provided tables in the shape of posts, jobs, stages, events and run history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import wall_micros, words
from tidemark.operators.keywords import count_mentions, mentions
from tidemark.operators.progress import (
    APP_START,
    JOB_END,
    JOB_START,
    STAGE_COMPLETED,
    STAGE_SUBMITTED,
    TASK_END,
    TASK_START,
)

# Frequent words of the documents, in place of the hashtags of posts.
WORDS = ["the", "of", "de", "and", "la", "der"]
APP = "orders"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(time: Column) -> Column:
    return F.floor(wall_micros(time) / 1000).cast("long")


def document_words(documents: DataFrame, *keep: str, watch=None) -> DataFrame:
    """One mention per word of each document."""
    return mentions(documents, words(F.col("text")), *keep, watch=watch)


def word_counts(documents: DataFrame, watch=WORDS) -> DataFrame:
    """(doc_id, hashtag, total): texts are reduced to counts before any join sees them."""
    return count_mentions(document_words(documents, "doc_id", watch=watch), "doc_id", "hashtag")


def sentiments(labels: DataFrame) -> DataFrame:
    sentiment = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive")
    return labels.select("doc_id", sentiment.otherwise("neutral").alias("sentiment"))


def tones(embedding: Column) -> Column:
    """Every entry of an embedding as a tone named after its place."""
    return F.transform(
        embedding,
        lambda x, i: F.struct(
            F.concat(F.lit("d"), i.cast("string")).alias("tone_name"), x.alias("score")
        ),
    )


def posts(documents: DataFrame) -> DataFrame:
    """Documents as nested posts: words as hashtags, language as sentiment, source as tone."""
    hashtags = F.transform(words(F.col("text")), lambda w: F.struct(w.alias("text")))
    sentiment = (
        F.when(F.col("lang") == "en", "positive")
        .when(F.col("lang") == "de", "negative")
        .otherwise("neutral")
    )
    score = F.col("n_chars").cast("double")
    tone = F.struct(F.col("source").alias("tone_name"), score.alias("score"))
    document_tone = F.struct(F.array(tone).alias("tones"))
    return documents.select(
        F.struct(hashtags.alias("hashtags")).alias("entities"),
        F.struct(
            sentiment.alias("sentiment"), document_tone.alias("document_tone")
        ).alias("tone"),
    )


def order_jobs(orders: DataFrame) -> DataFrame:
    """Job facts: an order is a job, its customer the handle, its priority the type."""
    status = F.col("o_orderstatus")
    return orders.select(
        F.lit(APP).alias("app_id"),
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").cast("string").alias("handle"),
        F.concat(F.lit("order "), status).alias("name"),
        F.col("o_orderpriority").alias("type"),
        F.col("o_orderdate").alias("started"),
        (status != "O").alias("complete"),
        (status == "P").alias("failed"),
    )


def line_stages(lineitem: DataFrame) -> DataFrame:
    """Stage facts: each order line is a stage with its quantity as the number of tasks."""
    tasks = F.col("l_quantity").cast("long")
    complete = F.col("l_linestatus") == "F"
    discounted = F.round(F.col("l_discount") * 100).cast("long")
    return lineitem.select(
        F.lit(APP).alias("app_id"),
        F.col("l_orderkey").alias("job_id"),
        F.col("l_linenumber").cast("long").alias("stage_id"),
        tasks.alias("num_tasks"),
        (complete | (F.col("l_returnflag") != "N")).alias("submitted"),
        F.col("l_shipdate").alias("submitted_at"),
        F.when(complete, tasks).otherwise(F.least(tasks, discounted)).alias("tasks_complete"),
        complete.alias("complete"),
    )


def order_history(orders: DataFrame) -> DataFrame:
    """Run history: each order starts a run, and completes it unless it is open."""
    kinds = F.when(F.col("o_orderstatus") == "O", F.array(F.lit("job_start"))).otherwise(
        F.array(F.lit("job_start"), F.lit("job_complete"))
    )
    return orders.select(
        F.col("o_custkey").cast("string").alias("job_handle"),
        F.col("o_orderdate").alias("ts"),
        F.posexplode(kinds),
        F.col("o_orderkey").alias("job_id"),
    ).select("job_handle", "ts", "job_id", F.col("pos").alias("step"), F.col("col").alias("event"))


def user_history(events: DataFrame) -> DataFrame:
    """Run history: a signup starts a user's run and a purchase completes it."""
    kind = F.col("event_type")
    event = F.when(kind == "signup", "job_start").when(kind == "purchase", "job_complete")
    return events.where(kind.isin("signup", "purchase")).select(
        F.col("user_id").alias("job_handle"), event.alias("event"), "ts", "event_id"
    )


def order_feed(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """An event feed: orders run as jobs, line numbers as stages, order lines as tasks.

    Job and stage ids are order key and order key * 8 + line number. A job lists all
    line numbers up to its largest one, so some of its stages are never submitted.
    Orders with status O have not ended, P has failed; a line has ended if its
    status is F. Ship dates before the order date give events of an unknown stage.
    """
    stage_id = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    launch = millis(F.col("l_shipdate"))
    finish = launch + F.col("l_quantity").cast("long") * 3_600_000
    ended = F.col("l_linestatus") == "F"

    lines = lineitem.select(
        "l_orderkey",
        "l_linenumber",
        stage_id.alias("stage"),
        (F.col("l_partkey") * (1 << 31) + F.col("l_suppkey")).alias("task"),
        launch.alias("launch"),
        finish.alias("finish"),
        ended.alias("ended"),
        (F.col("l_returnflag") == "R").alias("bad"),
    )
    # Their keys tell the stage, which so is not shuffled.
    stages = lines.groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("tasks"),
        F.min("launch").alias("submitted"),
        F.max("finish").alias("completed"),
        F.bool_and("ended").alias("ended"),
    ).withColumn("stage", stage_id)
    listed = lines.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("last_line"))
    jobs = orders.join(listed, F.col("o_orderkey") == F.col("l_orderkey"), "left")

    app_event = orders.agg(F.min(millis(F.col("o_orderdate"))).alias("Timestamp")).select(
        F.lit(APP_START).alias("Event"), F.lit("order feed").alias("App Name"), "Timestamp"
    )

    ids = F.transform(F.sequence(F.lit(1), "last_line"), lambda n: F.col("o_orderkey") * 8 + n)
    status = F.col("o_orderstatus")
    group = [F.lit("spark.jobGroup.id"), F.col("o_custkey").cast("string")]
    name = [F.lit("spark.job.name"), F.concat(F.lit("order "), status)]
    kind = [F.lit("spark.job.type"), F.col("o_orderpriority")]
    # A failed job carries neither name nor type.
    properties = F.when(status == "P", F.create_map(*group)).otherwise(
        F.create_map(*group, *name, *kind)
    )
    result = F.when(status == "P", "JobFailed").otherwise("JobSucceeded")
    kinds = F.when(status == "O", F.array(F.lit(JOB_START))).otherwise(
        F.array(F.lit(JOB_START), F.lit(JOB_END))
    )
    is_start = F.col("Event") == JOB_START
    job_events = jobs.select("*", F.explode(kinds).alias("Event")).select(
        "Event",
        F.col("o_orderkey").alias("Job ID"),
        F.when(
            is_start, F.coalesce(ids, F.array().cast("array<bigint>"))
        ).alias("Stage IDs"),
        F.when(is_start, properties).alias("Properties"),
        F.when(is_start, millis(F.col("o_orderdate"))).alias("Submission Time"),
        F.when(~is_start, F.struct(result.alias("Result"))).alias("Job Result"),
    )

    both = F.array(F.lit(STAGE_SUBMITTED), F.lit(STAGE_COMPLETED))
    kinds = F.when(F.col("ended"), both).otherwise(F.array(F.lit(STAGE_SUBMITTED)))
    info = F.struct(
        F.col("stage").alias("Stage ID"),
        F.col("tasks").alias("Number of Tasks"),
        F.col("submitted").alias("Submission Time"),
        F.when(F.col("Event") == STAGE_COMPLETED, F.col("completed")).alias("Completion Time"),
    )
    stage_events = stages.select("*", F.explode(kinds).alias("Event")).select(
        "Event", info.alias("Stage Info")
    )

    both = F.array(F.lit(TASK_START), F.lit(TASK_END))
    kinds = F.when(F.col("ended"), both).otherwise(F.array(F.lit(TASK_START)))
    is_end = F.col("Event") == TASK_END
    info = F.struct(
        F.col("task").alias("Task ID"),
        F.col("launch").alias("Launch Time"),
        F.when(is_end, F.col("finish")).alias("Finish Time"),
        (is_end & F.col("bad")).alias("Failed"),
    )
    task_events = lines.select("*", F.explode(kinds).alias("Event")).select(
        "Event", F.col("stage").alias("Stage ID"), info.alias("Task Info")
    )

    feed = app_event
    for part in (job_events, stage_events, task_events):
        feed = feed.unionByName(part, allowMissingColumns=True)
    return feed


def with_app(feed: DataFrame) -> DataFrame:
    return feed.withColumn("app_id", F.lit(APP))
