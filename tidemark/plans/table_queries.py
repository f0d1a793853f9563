"""One query per operator over the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import fields, trace_lines
from tidemark.operators import keywords as K
from tidemark.operators import progress as P
from tidemark.operators.asof import asof_join
from tidemark.operators.history import envelopes, history_events, run_state
from tidemark.operators.latest import retained_jobs
from tidemark.plans import facts
from tidemark.plans.facts import APP, WORDS, table, with_app
from tidemark.plans.reports import tag_text_mentions
from tidemark.plans.scripts import load_result, run_script, run_statement, save_result
from tidemark.schemas import HISTORY, SENTIMENT_POST, TONE_POST
from tidemark.session import checkpointed, shared_dir
from tidemark.sources.delimited import append_records, as_strings, save_sorted_csv
from tidemark.sources.event_log import follow_logs, read_events, stream_events, write_events
from tidemark.sources.posts import read_posts
from tidemark.sources.tables import dataset, raw_dataset
from tidemark.streaming import events as S
from tidemark.streaming import increments
from tidemark.streaming import stages as stage_streams


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in names})


# Keywords


def _weighted(spark, sf_dir, how):
    counts = facts.word_counts(table(spark, sf_dir, "documents"))
    return counts.join(facts.sentiments(table(spark, sf_dir, "labels")), "doc_id", how)


def keyword_sentiment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _weighted(spark, sf_dir, "left")
    counts = K.count_mentions(rows, "hashtag", "sentiment", weight="total")
    return counts.orderBy("hashtag", "sentiment")


def keyword_tone_means(spark, sf_dir):
    rows = _weighted(spark, sf_dir, "inner")
    embeddings = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "embedding"
    )
    sums = K.tone_sums(
        rows.join(embeddings, "doc_id"), facts.tones(F.col("embedding")), weight="total"
    )
    means = K.tone_means(sums).orderBy("hashtag", "tone")
    return _rounded(means, "mean_score", "mean_sentiment")


def _json_posts(spark, sf_dir, schema):
    path = shared_dir(spark, "posts")
    facts.posts(table(spark, sf_dir, "documents")).write.json(path)
    return read_posts(spark, path, schema, view="tidemark_posts")


def json_sentiment_counts(spark, sf_dir):
    return K.keyword_sentiment_counts(_json_posts(spark, sf_dir, SENTIMENT_POST), WORDS)


def json_tone_means(spark, sf_dir):
    means = K.keyword_tone_means(_json_posts(spark, sf_dir, TONE_POST), WORDS)
    return _rounded(means, "mean_score", "mean_sentiment")


def json_view_sql(spark, sf_dir):
    _json_posts(spark, sf_dir, SENTIMENT_POST)
    tagged = run_statement(
        spark,
        "SELECT explode(entities.hashtags.text) AS hashtag, tone.sentiment FROM tidemark_posts",
    )
    watched = K.keep_watched(tagged, WORDS, "hashtag")
    return K.count_mentions(watched, "hashtag", "sentiment")


def keyword_vocabulary_counts(spark, sf_dir):
    vocabulary = facts.document_words(table(spark, sf_dir, "benchmark")).distinct()
    rows = facts.document_words(table(spark, sf_dir, "documents"))
    return K.keep_watched(K.count_mentions(rows, "hashtag"), vocabulary, "hashtag")


def keyword_popularity(spark, sf_dir):
    return K.popularity(facts.document_words(table(spark, sf_dir, "documents")))


def top_keywords(spark, sf_dir):
    return K.most_popular(facts.document_words(table(spark, sf_dir, "documents")), 20)


def second_token_counts(spark, sf_dir):
    return K.popularity(tag_text_mentions(table(spark, sf_dir, "documents"), "text"))


def _by_source(spark, sf_dir):
    rows = facts.document_words(table(spark, sf_dir, "documents"), "source")
    return K.count_mentions(rows, "source", "hashtag")


def keyword_by_source(spark, sf_dir):
    return _by_source(spark, sf_dir)


def top_keywords_per_source(spark, sf_dir):
    return K.top_per_region(_by_source(spark, sf_dir), 5, "source")


def many_keywords_per_source(spark, sf_dir):
    # Ranking reads the counts several times, so the texts are split once before it.
    return K.top_per_region(checkpointed(_by_source(spark, sf_dir)), 5000, "source")


def keyword_value_runs(spark, sf_dir):
    rows = facts.document_words(table(spark, sf_dir, "documents"), "source", watch=WORDS)
    return K.value_runs(rows, "hashtag", "source")


def keyword_text_positions(spark, sf_dir):
    """Where each run of a word stands in the text that all words of a source make."""
    rows = facts.document_words(table(spark, sf_dir, "documents"), "source")
    # Positions read the runs several times, so the texts are split once before it.
    runs = checkpointed(K.value_runs(rows, "source", "hashtag"))
    return K.run_positions(runs, "source", "hashtag")


def keyword_report_csv(spark, sf_dir):
    path = shared_dir(spark, "report")
    save_sorted_csv(keyword_sentiment_counts(spark, sf_dir), path, ["hashtag", "sentiment"])
    schema = "hashtag string, sentiment string, total long"
    return spark.read.schema(schema).option("lineSep", "\r\n").csv(path)


# Tables, scripts and saved results


def _view(spark, sf_dir, name):
    table(spark, sf_dir, name).createOrReplaceTempView(f"tidemark_{name}")
    return f"tidemark_{name}"


def dataset_preview(spark, sf_dir):
    return dataset(spark, _view(spark, sf_dir, "orders")).orderBy("o_orderkey").limit(20)


def row_cap(spark, sf_dir):
    capped = dataset(spark, _view(spark, sf_dir, "lineitem"), limit=5000)
    return capped.agg(F.count(F.lit(1)).alias("n_rows"))


def raw_lines(spark, sf_dir):
    root = shared_dir(spark, "raw")
    table(spark, sf_dir, "documents").select("text").write.text(f"{root}/documents")
    lines = raw_dataset(spark, root, "documents")
    return lines.groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("total"))


def sql_script(spark, sf_dir):
    lineitem, orders = _view(spark, sf_dir, "lineitem"), _view(spark, sf_dir, "orders")
    return run_script(
        spark,
        [
            f"""CREATE OR REPLACE TEMP VIEW tidemark_revenue AS
                SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS revenue
                FROM {lineitem} GROUP BY l_orderkey""",
            f"""SELECT o_orderpriority, count(*) AS n_orders, round(sum(revenue), 2) AS revenue
                FROM {orders} JOIN tidemark_revenue ON l_orderkey = o_orderkey
                GROUP BY o_orderpriority""",
        ],
    )


def sql_script_block(spark, sf_dir):
    customer, orders = _view(spark, sf_dir, "customer"), _view(spark, sf_dir, "orders")
    return run_script(
        spark,
        f"""
        CREATE OR REPLACE TEMP VIEW tidemark_spend AS
          SELECT o_custkey, count(*) AS n_orders FROM {orders} GROUP BY o_custkey;
        SELECT c_mktsegment, sum(n_orders) AS n_orders
        FROM {customer} JOIN tidemark_spend ON o_custkey = c_custkey
        GROUP BY c_mktsegment;
        """,
    )


def saved_result_roundtrip(spark, sf_dir):
    path = shared_dir(spark, "result")
    save_result(table(spark, sf_dir, "orders"), path)
    return load_result(spark, path)


def saved_text_roundtrip(spark, sf_dir):
    path = shared_dir(spark, "result")
    save_result(table(spark, sf_dir, "documents"), path)
    return load_result(spark, path)


def rows_as_strings(spark, sf_dir):
    return as_strings(table(spark, sf_dir, "orders"))


def split_rows(spark, sf_dir):
    rows = as_strings(table(spark, sf_dir, "part"))
    cells = fields(F.concat_ws("\t", *rows.columns))
    return rows.select(cells.alias("c")).select(
        F.size("c").alias("n_fields"), *[F.get("c", F.lit(i)).alias(f"c{i}") for i in range(6)]
    )


# Job progress over facts


def _jobs(spark, sf_dir):
    return facts.order_jobs(table(spark, sf_dir, "orders"))


def _progress(spark, sf_dir, job_type=None):
    jobs = P.of_type(_jobs(spark, sf_dir), job_type)
    progress = P.job_progress(jobs, facts.line_stages(table(spark, sf_dir, "lineitem")))
    return _rounded(progress, "stage_progress", "task_progress")


def progress_by_job(spark, sf_dir):
    return _progress(spark, sf_dir)


def progress_of_type(spark, sf_dir):
    return _progress(spark, sf_dir, "1-URGENT")


def current_unit(spark, sf_dir):
    return _progress(spark, sf_dir).where(F.col("current_stage").isNotNull()).select(
        "job_id", "current_stage", "current_tasks", "current_complete_tasks", "task_progress"
    )


def unit_states(spark, sf_dir):
    states = P.stage_states(facts.line_stages(table(spark, sf_dir, "lineitem")))
    return states.groupBy("job_id", "state").agg(F.count(F.lit(1)).alias("n_stages"))


def running_count(spark, sf_dir):
    return P.running_count(_jobs(spark, sf_dir))


def running_count_by_type(spark, sf_dir):
    return P.running_count(_jobs(spark, sf_dir), "type")


def latest_job_per_handle(spark, sf_dir):
    return P.latest_jobs(_jobs(spark, sf_dir), order=("started", "job_id"))


def progress_by_handle(spark, sf_dir):
    history = facts.order_history(table(spark, sf_dir, "orders"))
    runs = run_state(history, ("ts", "job_id", "step"))
    stages = facts.line_stages(table(spark, sf_dir, "lineitem"))
    rows = P.handle_progress(_jobs(spark, sf_dir), stages, runs)
    names = ("handle", "job_id", "stage_progress", "complete", "failed", "running")
    return _rounded(rows.select(*names), "stage_progress")


def handle_rollup(spark, sf_dir):
    return _rounded(P.handle_rollup(_progress(spark, sf_dir)), "stage_progress")


def retained(spark, sf_dir):
    return retained_jobs(_jobs(spark, sf_dir), app="type")


def retained_per_handle(spark, sf_dir):
    return retained_jobs(_jobs(spark, sf_dir), keep=5, app="handle")


def owner_asof(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    purchases = events.where("event_type = 'purchase'").select("user_id", "event_id", "ts", "value")
    signups = events.where("event_type = 'signup'").select(
        "user_id", F.col("event_id").alias("signup_id"), F.col("ts").alias("signup_ts")
    )
    return asof_join(purchases, signups, ["user_id"], "ts", "signup_ts", "signup_id")


# Job progress over an event feed


def _feed(spark, sf_dir):
    return facts.order_feed(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


def _feed_facts(spark, sf_dir, **options):
    path = shared_dir(spark, "events")
    write_events(with_app(_feed(spark, sf_dir)), path)
    return P.facts_from_events(spark.read.parquet(path), **options)


def feed_apps(spark, sf_dir):
    return P.app_starts(with_app(_feed(spark, sf_dir)))


def feed_jobs(spark, sf_dir):
    jobs = P.jobs_from_events(with_app(_feed(spark, sf_dir)))
    ids = F.concat_ws(",", F.col("stage_ids").cast("array<string>"))
    return jobs.withColumns({"n_stages": F.size("stage_ids"), "stages": ids}).drop("stage_ids")


def feed_stages(spark, sf_dir):
    return _feed_facts(spark, sf_dir)[1]


def feed_stages_without_failures(spark, sf_dir):
    stages = _feed_facts(spark, sf_dir, failed_count=False)[1]
    return stages.select("job_id", "stage_id", "tasks_complete")


def feed_tasks(spark, sf_dir):
    path = shared_dir(spark, "events")
    write_events(with_app(_feed(spark, sf_dir)), path)
    events = spark.read.parquet(path)
    return P.owned_tasks(events, P.jobs_from_events(events))


def feed_stage_lists(spark, sf_dir):
    lists = P.stage_lists(*_feed_facts(spark, sf_dir))

    def joined(name):
        return F.concat_ws(",", F.col(name).cast("array<string>")).alias(name)

    return lists.select("job_id", joined("waiting"), joined("in_progress"), joined("complete"))


def feed_progress(spark, sf_dir):
    progress = P.job_progress(*_feed_facts(spark, sf_dir))
    return _rounded(progress, "stage_progress", "task_progress")


def _feed_files(spark, sf_dir):
    """The feed as logs of bounded length; packed, since JSON takes many times the disk of its tables."""
    path = shared_dir(spark, "feed")
    _feed(spark, sf_dir).write.option("compression", "lz4").option("maxRecordsPerFile", 2_000_000).json(path)
    return path


def log_progress(spark, sf_dir):
    path = shared_dir(spark, "events")
    write_events(read_events(spark, _feed_files(spark, sf_dir), APP), path)
    return _rounded(S.progress_of_feed(spark, path), "stage_progress", "task_progress")


# Streams


def event_counts_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    # A pattern, since a file stream takes a folder or a pattern but no single file.
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    out = shared_dir(spark, "counts")
    checkpoint = shared_dir(spark, "checkpoint")
    S.event_counts(events, out, checkpoint, "event_type").awaitTermination()
    return S.latest_result(spark, out)


def progress_stream(spark, sf_dir):
    events = stream_events(spark, _feed_files(spark, sf_dir), APP)
    out, checkpoint = shared_dir(spark, "ingested"), shared_dir(spark, "checkpoint")
    S.ingest(events, out, checkpoint).awaitTermination()
    return _rounded(S.progress_of_feed(spark, out), "stage_progress", "task_progress")


def followed_log_progress(spark, sf_dir):
    """The feed arrives in two parts as logs that are followed, the second after a first run."""
    feed, path = _feed(spark, sf_dir), shared_dir(spark, "logs")
    out, checkpoint = shared_dir(spark, "ingested"), shared_dir(spark, "checkpoint")
    job = F.coalesce("Job ID", F.floor(F.coalesce("Stage ID", F.col("Stage Info")["Stage ID"]) / 8))
    late = F.coalesce(job % 2, F.lit(0)) == 1
    for part in (feed.where(~late), feed.where(late)):
        # Fast packing: these logs are read once, and packing them is a large part of writing them.
        packed = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
        part.write.mode("append").options(**packed).option("maxRecordsPerFile", 2_000_000).json(path)
        S.ingest(follow_logs(spark, path, APP), out, checkpoint).awaitTermination()
    return _rounded(S.progress_of_feed(spark, out), "stage_progress", "task_progress")


def tracked_progress_stream(spark, sf_dir):
    """The feed in several batches, the sums of which are merged on the way."""
    path = _feed_files(spark, sf_dir)
    files = len([f for f in spark.read.text(path).inputFiles() if ".json" in f])
    events = stream_events(spark, path, APP, files_per_trigger=max(1, -(-files // 3)))
    store, checkpoint = shared_dir(spark, "tracked"), shared_dir(spark, "checkpoint")
    increments.track(events, store, checkpoint, every=2).awaitTermination()
    return _rounded(increments.tracked_progress(spark, store), "stage_progress", "task_progress")


def closed_stages_stream(spark, sf_dir):
    events = stream_events(spark, _feed_files(spark, sf_dir), APP)
    out, checkpoint = shared_dir(spark, "closed"), shared_dir(spark, "checkpoint")
    month = 30 * 24 * 3_600_000
    stage_streams.closed_stages(events, out, checkpoint, "1 day", month).awaitTermination()
    return stage_streams.closed_stage_rows(spark, out)


def owned_events_stream(spark, sf_dir):
    events = stream_events(spark, _feed_files(spark, sf_dir), APP)
    out, checkpoint = shared_dir(spark, "owned"), shared_dir(spark, "checkpoint")
    stage_streams.owned_stream(events, out, checkpoint, "1 day", "60 days").awaitTermination()
    states = stage_streams.owned_states(spark, out, P.counters())
    return states.select("job_id", "stage_id", "num_tasks", "submitted_at", "tasks_started", "tasks_complete", "complete")


def stage_state_stream(spark, sf_dir):
    events = stream_events(spark, _feed_files(spark, sf_dir), APP)
    out, checkpoint = shared_dir(spark, "states"), shared_dir(spark, "checkpoint")
    S.stage_states(events, out, checkpoint).awaitTermination()
    return S.latest_rows(spark, out, ["app_id", "stage_id"])


# Run history and outcomes


def history_running(spark, sf_dir):
    history = facts.user_history(table(spark, sf_dir, "events"))
    return run_state(history, ("ts", "event_id"))


def history_roundtrip(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    path = shared_dir(spark, "history")
    common = {
        "account": F.col("o_orderpriority"),
        "user": F.col("o_custkey"),
        "handle": F.col("o_orderkey"),
        "job_type": F.lit("sql"),
        "data": F.struct(F.col("o_orderstatus").alias("jobName")),
        "ts": F.col("o_orderdate"),
    }
    append_records(history_events(orders, "job_start", **common), path)
    ended = orders.where("o_orderstatus <> 'O'")
    append_records(history_events(ended, "job_complete", **common), path)
    # The wall time, which does not depend on the zone of the session.
    return spark.read.schema(HISTORY).parquet(path).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def envelope_json(spark, sf_dir):
    failed = F.col("o_orderstatus") == "P"
    data = F.struct(
        F.concat(F.lit("results/"), F.col("o_orderkey").cast("string")).alias("outputDir"),
        F.col("o_orderkey").alias("handle"),
        F.when(failed, F.split("o_orderpriority", "-")).alias("trace"),
    )
    options = F.struct(F.col("o_orderpriority").alias("jobName"))
    return envelopes(table(spark, sf_dir, "orders"), F.col("o_orderkey"), ~failed, data, options)


def trace_line_counts(spark, sf_dir):
    lines = trace_lines(F.col("html"))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.size(lines).cast("long").alias("n_lines"),
        F.md5(F.concat_ws("|", lines)).alias("digest"),
    )


# SQL passed through to Spark


def _sql(statement, *names):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_statement(spark, statement.format(**{n: _view(spark, sf_dir, n) for n in names}))

    return query


sql_join = _sql(
    """SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS spent
       FROM {customer} JOIN {orders} ON o_custkey = c_custkey
       JOIN {nation} ON n_nationkey = c_nationkey GROUP BY n_name""",
    "customer", "orders", "nation",
)
sql_anti_join = _sql(
    """SELECT o_orderkey, o_custkey FROM {orders}
       LEFT ANTI JOIN {lineitem} ON l_orderkey = o_orderkey""",
    "orders", "lineitem",
)
sql_rollup = _sql(
    """SELECT l_returnflag, l_linestatus, count(*) AS n_lines,
              CAST(sum(l_quantity) AS BIGINT) AS quantity
       FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "lineitem",
)
sql_window = _sql(
    """SELECT o_custkey, o_orderkey, recency FROM (
         SELECT o_custkey, o_orderkey, row_number() OVER (
           PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS recency
         FROM {orders}) WHERE recency <= 3""",
    "orders",
)
sql_set_operations = _sql(
    """SELECT c_nationkey AS nation FROM {customer} UNION SELECT s_nationkey FROM {supplier}
       EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_acctbal < 0""",
    "customer", "supplier",
)

QUERIES = {
    function.__name__: function
    for function in (
        keyword_sentiment_counts,
        keyword_tone_means,
        json_sentiment_counts,
        json_tone_means,
        json_view_sql,
        keyword_vocabulary_counts,
        keyword_popularity,
        top_keywords,
        second_token_counts,
        keyword_by_source,
        top_keywords_per_source,
        many_keywords_per_source,
        keyword_value_runs,
        keyword_text_positions,
        keyword_report_csv,
        dataset_preview,
        row_cap,
        raw_lines,
        sql_script,
        sql_script_block,
        saved_result_roundtrip,
        saved_text_roundtrip,
        rows_as_strings,
        split_rows,
        progress_by_job,
        progress_of_type,
        current_unit,
        unit_states,
        running_count,
        running_count_by_type,
        latest_job_per_handle,
        progress_by_handle,
        handle_rollup,
        owner_asof,
        feed_apps,
        feed_jobs,
        feed_stages,
        feed_stages_without_failures,
        feed_tasks,
        feed_stage_lists,
        feed_progress,
        log_progress,
        event_counts_stream,
        progress_stream,
        stage_state_stream,
        followed_log_progress,
        tracked_progress_stream,
        closed_stages_stream,
        owned_events_stream,
        history_running,
        history_roundtrip,
        envelope_json,
        trace_line_counts,
    )
} | {
    "retained_jobs": retained,
    "retained_jobs_per_handle": retained_per_handle,
    "sql_join": sql_join,
    "sql_anti_join": sql_anti_join,
    "sql_rollup": sql_rollup,
    "sql_window": sql_window,
    "sql_set_operations": sql_set_operations,
}
