"""The same queries as SQL for DuckDB over the same tables."""

_SENTIMENTS = """
    SELECT doc_id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive'
                        ELSE 'neutral' END AS sentiment FROM labels"""
_ALL_WORDS = """
    SELECT doc_id, source, lang, n_chars, unnest(string_split(text, ' ')) AS hashtag
    FROM documents"""
_WORDS = f"""
    SELECT * FROM ({_ALL_WORDS}) WHERE hashtag IN ('the', 'of', 'de', 'and', 'la', 'der')"""
_LANG_SENTIMENT = "CASE lang WHEN 'en' THEN 'positive' WHEN 'de' THEN 'negative' ELSE 'neutral' END"
_LANG_VALUE = "CASE lang WHEN 'en' THEN 1.0 WHEN 'de' THEN -1.0 ELSE 0.0 END"

_SENTIMENT_COUNTS = f"""
    SELECT hashtag, sentiment, count(*) AS total
    FROM ({_WORDS}) LEFT JOIN ({_SENTIMENTS}) USING (doc_id) GROUP BY ALL"""
_JSON_COUNTS = f"""
    SELECT hashtag, {_LANG_SENTIMENT} AS sentiment, count(*) AS total
    FROM ({_WORDS}) GROUP BY ALL"""

_JOBS = """
    SELECT 'orders' AS app_id, o_orderkey AS job_id, CAST(o_custkey AS VARCHAR) AS handle,
           'order ' || o_orderstatus AS name, o_orderpriority AS type, o_orderdate AS started,
           o_orderstatus <> 'O' AS complete, o_orderstatus = 'P' AS failed FROM orders"""
_STAGES = """
    SELECT l_orderkey AS job_id, CAST(l_linenumber AS BIGINT) AS stage_id,
           CAST(l_quantity AS BIGINT) AS num_tasks,
           l_linestatus = 'F' OR l_returnflag <> 'N' AS submitted, l_shipdate AS submitted_at,
           CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT)
                ELSE least(CAST(l_quantity AS BIGINT), CAST(round(l_discount * 100) AS BIGINT))
           END AS tasks_complete,
           l_linestatus = 'F' AS complete FROM lineitem"""


def _progress(jobs: str, stages: str) -> str:
    return f"""
    WITH jobs AS ({jobs}), stages AS ({stages}),
    rollup AS (SELECT job_id, count(*) AS total, count(*) FILTER (complete) AS done
               FROM stages GROUP BY job_id),
    current AS (
      SELECT * FROM stages WHERE submitted AND NOT complete
      QUALIFY row_number() OVER (PARTITION BY job_id
        ORDER BY submitted_at, stage_id, num_tasks, tasks_complete) = 1)
    SELECT app_id, job_id, handle, name, type, started, jobs.complete, failed,
           coalesce(total, 1) AS total_stages,
           CASE WHEN total IS NULL THEN 1 ELSE done END AS complete_stages,
           round(CASE WHEN total IS NULL THEN 1.0 ELSE done::DOUBLE / total END, 6)
             AS stage_progress,
           stage_id AS current_stage,
           CASE WHEN num_tasks = 0 THEN 1 ELSE num_tasks END AS current_tasks,
           CASE WHEN num_tasks = 0 THEN 1 ELSE tasks_complete END AS current_complete_tasks,
           round(CASE WHEN num_tasks = 0 THEN 1.0 ELSE tasks_complete::DOUBLE / num_tasks END, 6)
             AS task_progress
    FROM jobs LEFT JOIN rollup USING (job_id) LEFT JOIN current USING (job_id)"""


_PROGRESS = _progress(_JOBS, _STAGES)

_FEED_JOBS = """
    SELECT 'orders' AS app_id, o_orderkey AS job_id, CAST(o_custkey AS VARCHAR) AS handle,
           CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'order ' || o_orderstatus END AS name,
           CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS type,
           epoch_ms(o_orderdate) AS started,
           o_orderstatus <> 'O' AS complete, o_orderstatus = 'P' AS failed,
           coalesce(last_line, 0)::INTEGER AS n_stages,
           coalesce(array_to_string(list_transform(range(1, last_line + 1),
             lambda n: o_orderkey * 8 + n), ','), '') AS stages
    FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS last_line
                           FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""
_FEED_LINES = """
    SELECT l_orderkey AS job_id, l_orderkey * 8 + l_linenumber AS stage_id,
           epoch_ms(l_shipdate) AS launch,
           epoch_ms(l_shipdate) + CAST(l_quantity AS BIGINT) * 3600000 AS finish,
           l_linestatus = 'F' AS ended, l_returnflag = 'R' AS bad,
           epoch_ms(o_orderdate) AS job_started
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""
_FEED_STATES = f"""
    SELECT job_id, stage_id,
           CASE WHEN min(launch) >= any_value(job_started) THEN count(*) END AS num_tasks,
           min(launch) >= any_value(job_started) AS submitted,
           CASE WHEN min(launch) >= any_value(job_started) THEN min(launch) END AS submitted_at,
           count(*) FILTER (launch >= job_started) AS tasks_started,
           count(*) FILTER (ended AND launch >= job_started) AS ended_tasks,
           count(*) FILTER (ended AND launch >= job_started AND NOT bad) AS good_tasks,
           bool_and(ended) AND min(launch) >= any_value(job_started) AS complete
    FROM ({_FEED_LINES}) GROUP BY job_id, stage_id"""
_FEED_STAGES = f"""
    SELECT 'orders' AS app_id, listed.job_id, listed.stage_id,
           coalesce(num_tasks, 0) AS num_tasks, coalesce(submitted, false) AS submitted,
           submitted_at, coalesce(tasks_started, 0) AS tasks_started,
           coalesce(tasks_started - ended_tasks, 0) AS tasks_in_progress,
           coalesce(ended_tasks, 0) AS tasks_complete, coalesce(complete, false) AS complete
    FROM (SELECT l_orderkey AS job_id, l_orderkey * 8 + unnest(range(1, max(l_linenumber) + 1))
                 AS stage_id FROM lineitem GROUP BY l_orderkey) listed
    LEFT JOIN ({_FEED_STATES}) states ON states.stage_id = listed.stage_id"""
_FEED_PROGRESS = _progress(_FEED_JOBS, f"SELECT * EXCLUDE (app_id) FROM ({_FEED_STAGES})")


def _history(fields: str, where: str = "true") -> str:
    return f"""
    SELECT o_orderpriority AS account_id, CAST(o_custkey AS VARCHAR) AS user_id, {fields},
           'sql' AS job_type, CAST(NULL AS VARCHAR) AS job_id,
           CAST(o_orderkey AS VARCHAR) AS job_handle,
           '{{"jobName":"' || o_orderstatus || '"}}' AS data,
           CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders WHERE {where}"""


def _ids(state: str) -> str:
    ids = "string_agg(CAST(stage_id AS VARCHAR), ',' ORDER BY stage_id)"
    return f"coalesce({ids} FILTER ({state}), '')"


ORACLES = {
    "keyword_sentiment_counts": _SENTIMENT_COUNTS,
    "keyword_report_csv": _SENTIMENT_COUNTS,
    "keyword_tone_means": f"""
        SELECT hashtag, 'd' || i AS tone, round(avg(embedding[i + 1]::DOUBLE), 6) AS mean_score,
               round(avg(CASE sentiment WHEN 'negative' THEN -1.0 WHEN 'positive' THEN 1.0
                         ELSE 0.0 END::DOUBLE), 6) AS mean_sentiment, count(*) AS total
        FROM ({_WORDS}) JOIN ({_SENTIMENTS}) USING (doc_id)
        JOIN (SELECT vec_id AS doc_id, embedding, unnest(range(0, len(embedding))) AS i
              FROM embeddings) USING (doc_id)
        GROUP BY ALL""",
    "json_sentiment_counts": _JSON_COUNTS,
    "json_view_sql": _JSON_COUNTS,
    "json_tone_means": f"""
        SELECT hashtag, source AS tone, round(avg(n_chars::DOUBLE), 6) AS mean_score,
               round(avg(({_LANG_VALUE})::DOUBLE), 6) AS mean_sentiment, count(*) AS total
        FROM ({_WORDS}) GROUP BY ALL""",
    "keyword_vocabulary_counts": f"""
        SELECT hashtag, count(*) AS total FROM ({_ALL_WORDS})
        WHERE hashtag IN (SELECT unnest(string_split(text, ' ')) FROM benchmark)
        GROUP BY ALL""",
    "keyword_popularity": f"SELECT count(*) AS total, hashtag FROM ({_ALL_WORDS}) GROUP BY hashtag",
    "top_keywords": f"""
        SELECT hashtag, count(*) AS total FROM ({_ALL_WORDS})
        GROUP BY hashtag ORDER BY total DESC, hashtag LIMIT 20""",
    "second_token_counts": r"""
        SELECT count(*) AS total, hashtag FROM (
          SELECT list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda t: t <> '')[2]
            AS hashtag FROM documents)
        WHERE hashtag IS NOT NULL GROUP BY hashtag""",
    "keyword_by_source": f"""
        SELECT source, hashtag, count(*) AS total FROM ({_ALL_WORDS}) GROUP BY ALL""",
    "top_keywords_per_source": f"""
        SELECT source, hashtag, total, CAST(rank AS INTEGER) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY source ORDER BY total DESC, hashtag) AS rank
          FROM (SELECT source, hashtag, count(*) AS total FROM ({_ALL_WORDS}) GROUP BY ALL))
        WHERE rank <= 5""",
    "many_keywords_per_source": f"""
        SELECT source, hashtag, total, CAST(rank AS INTEGER) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY source ORDER BY total DESC, hashtag) AS rank
          FROM (SELECT source, hashtag, count(*) AS total FROM ({_ALL_WORDS}) GROUP BY ALL))
        WHERE rank <= 5000""",
    "keyword_value_runs": f"""
        SELECT hashtag, source, count(*) AS copies FROM ({_WORDS}) GROUP BY ALL""",
    "keyword_text_positions": f"""
        SELECT source, hashtag, copies,
               CAST(coalesce(sum(length(hashtag) * copies) OVER (
                 PARTITION BY source ORDER BY hashtag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
               CAST(sum(length(hashtag) * copies) OVER (PARTITION BY source) AS BIGINT) AS n_chars
        FROM (SELECT source, hashtag, count(*) AS copies FROM ({_ALL_WORDS}) GROUP BY ALL)""",
    "dataset_preview": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 20",
    "row_cap": "SELECT count(*) AS n_rows FROM (SELECT * FROM lineitem LIMIT 5000)",
    "raw_lines": """
        SELECT line, count(*) AS total
        FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line""",
    "sql_script": """
        SELECT o_orderpriority, count(*) AS n_orders, round(sum(revenue), 2) AS revenue
        FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS revenue
                          FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
        GROUP BY o_orderpriority""",
    "sql_script_block": """
        SELECT c_mktsegment, CAST(sum(n_orders) AS BIGINT) AS n_orders
        FROM customer JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey)
          ON o_custkey = c_custkey
        GROUP BY c_mktsegment""",
    "saved_result_roundtrip": "SELECT * FROM orders",
    "saved_text_roundtrip": "SELECT * FROM documents",
    "rows_as_strings": """
        SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
               o_orderstatus, CAST(o_totalprice AS VARCHAR) AS o_totalprice,
               CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority FROM orders""",
    "split_rows": """
        SELECT 6 AS n_fields, CAST(p_partkey AS VARCHAR) AS c0, p_name AS c1, p_brand AS c2,
               p_type AS c3, CAST(p_size AS VARCHAR) AS c4, CAST(p_retailprice AS VARCHAR) AS c5
        FROM part""",
    "progress_by_job": _PROGRESS,
    "progress_of_type": f"SELECT * FROM ({_PROGRESS}) WHERE type = '1-URGENT'",
    "current_unit": f"""
        SELECT job_id, current_stage, current_tasks, current_complete_tasks, task_progress
        FROM ({_PROGRESS}) WHERE current_stage IS NOT NULL""",
    "unit_states": f"""
        SELECT job_id, CASE WHEN complete THEN 'complete' WHEN submitted THEN 'in_progress'
                            ELSE 'waiting' END AS state, count(*) AS n_stages
        FROM ({_STAGES}) GROUP BY ALL""",
    "running_count": "SELECT count(*) FILTER (o_orderstatus = 'O') AS running FROM orders",
    "running_count_by_type": """
        SELECT o_orderpriority AS type, count(*) FILTER (o_orderstatus = 'O') AS running
        FROM orders GROUP BY o_orderpriority""",
    "latest_job_per_handle": f"""
        SELECT * FROM ({_JOBS})
        QUALIFY row_number() OVER (PARTITION BY handle ORDER BY started DESC, job_id DESC) = 1""",
    "progress_by_handle": f"""
        WITH history AS (
          SELECT CAST(o_custkey AS VARCHAR) AS handle, o_orderstatus AS status,
                 row_number() OVER (PARTITION BY o_custkey
                                    ORDER BY o_orderdate DESC, o_orderkey DESC) AS recency
          FROM orders)
        SELECT handle, job_id, stage_progress, complete, failed, status = 'O' AS running
        FROM ({_PROGRESS}) JOIN history USING (handle) JOIN orders ON o_orderkey = job_id
        WHERE recency = 1
        QUALIFY row_number() OVER (PARTITION BY handle ORDER BY o_orderdate DESC, job_id DESC) = 1""",
    "handle_rollup": f"""
        SELECT app_id, handle, count(*) AS jobs, count(*) FILTER (complete) AS complete_jobs,
               count(*) FILTER (failed) AS failed_jobs,
               CAST(sum(total_stages) AS BIGINT) AS total_stages,
               CAST(sum(complete_stages) AS BIGINT) AS complete_stages,
               round(sum(complete_stages)::DOUBLE / sum(total_stages)::DOUBLE, 6) AS stage_progress
        FROM ({_PROGRESS}) GROUP BY app_id, handle""",
    "retained_jobs": f"""
        SELECT * FROM ({_JOBS})
        QUALIFY NOT complete OR row_number() OVER (
          PARTITION BY type ORDER BY complete, started DESC, job_id DESC) <= 100""",
    "retained_jobs_per_handle": f"""
        SELECT * FROM ({_JOBS})
        QUALIFY NOT complete OR row_number() OVER (
          PARTITION BY handle ORDER BY complete, started DESC, job_id DESC) <= 5""",
    "owner_asof": """
        WITH purchases AS (SELECT user_id, event_id, ts, value FROM events
                           WHERE event_type = 'purchase'),
             signups AS (SELECT user_id, event_id AS signup_id, ts AS signup_ts FROM events
                         WHERE event_type = 'signup')
        SELECT p.*, signup_id, signup_ts FROM purchases p ASOF JOIN signups s
          ON p.user_id = s.user_id AND p.ts >= s.signup_ts""",
    "feed_apps": """
        SELECT 'orders' AS app_id, 'order feed' AS app_name, min(epoch_ms(o_orderdate)) AS started
        FROM orders""",
    "feed_jobs": _FEED_JOBS,
    "feed_stages": _FEED_STAGES,
    "feed_stages_without_failures": f"""
        SELECT s.job_id, s.stage_id, coalesce(good_tasks, 0) AS tasks_complete
        FROM ({_FEED_STAGES}) s LEFT JOIN ({_FEED_STATES}) t ON t.stage_id = s.stage_id""",
    "feed_tasks": """
        SELECT 'orders' AS app_id, l_orderkey * 8 + l_linenumber AS stage_id,
               l_partkey * 2147483648 + l_suppkey AS task_id, max(epoch_ms(l_shipdate)) AS started,
               max(CASE WHEN l_linestatus = 'F' THEN
                 epoch_ms(l_shipdate) + CAST(l_quantity AS BIGINT) * 3600000 END) AS finished,
               finished - started AS duration,
               any_value(CASE WHEN l_shipdate >= o_orderdate THEN o_orderkey END) AS job_id
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3""",
    "feed_stage_lists": f"""
        SELECT o_orderkey AS job_id,
               {_ids('stage_id IS NOT NULL AND NOT submitted AND NOT complete')} AS waiting,
               {_ids('submitted AND NOT complete')} AS in_progress, {_ids('complete')} AS complete
        FROM orders LEFT JOIN ({_FEED_STAGES}) s ON s.job_id = o_orderkey GROUP BY o_orderkey""",
    "feed_progress": _FEED_PROGRESS,
    "log_progress": _FEED_PROGRESS,
    "progress_stream": _FEED_PROGRESS,
    "event_counts_stream": "SELECT event_type, count(*) AS total FROM events GROUP BY event_type",
    "stage_state_stream": """
        SELECT 'orders' AS app_id, l_orderkey * 8 + l_linenumber AS stage_id,
               count(*) AS num_tasks, true AS submitted, count(*) AS tasks_started,
               count(*) FILTER (l_linestatus = 'F') AS tasks_complete,
               bool_and(l_linestatus = 'F') AS complete
        FROM lineitem GROUP BY 1, 2""",
    "followed_log_progress": _FEED_PROGRESS,
    "tracked_progress_stream": _FEED_PROGRESS,
    "closed_stages_stream": """
        WITH l AS (
          SELECT l_orderkey * 8 + l_linenumber AS stage_id, epoch_ms(l_shipdate) AS launch,
                 epoch_ms(l_shipdate) + CAST(l_quantity AS BIGINT) * 3600000 AS finish,
                 l_linestatus = 'F' AS ended, l_returnflag = 'R' AS bad FROM lineitem),
        s AS (
          SELECT stage_id, count(*) AS num_tasks, bool_and(ended) AS complete, count(*) AS tasks_started,
                 count(*) FILTER (ended) AS tasks_complete, count(*) FILTER (ended AND bad) AS tasks_failed,
                 max(CASE WHEN ended THEN finish ELSE launch END) AS last_event,
                 CASE WHEN bool_and(ended) THEN max(finish) END AS ended_at FROM l GROUP BY stage_id)
        SELECT 'orders' AS app_id, stage_id, num_tasks, true AS submitted, complete, tasks_started,
               tasks_complete, tasks_failed, last_event, ended_at FROM s
        QUALIFY coalesce(ended_at, last_event + 30 * 86400000::BIGINT) < max(last_event) OVER () - 86400000""",
    "owned_events_stream": """
        WITH l AS (
          SELECT l_orderkey AS job_id, l_orderkey * 8 + l_linenumber AS stage_id, epoch_ms(l_shipdate) AS launch,
                 epoch_ms(o_orderdate) AS started, l_linestatus = 'F' AS ended
          FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
        s AS (SELECT stage_id, min(launch) AS submitted, count(*) AS tasks, bool_and(ended) AS over FROM l GROUP BY stage_id),
        t AS (SELECT *, submitted BETWEEN started AND started + 60 * 86400000::BIGINT AS own,
                     launch BETWEEN started AND started + 60 * 86400000::BIGINT AS own_task FROM l JOIN s USING (stage_id))
        SELECT job_id, stage_id, max(CASE WHEN own THEN tasks END) AS num_tasks,
               min(CASE WHEN own THEN submitted END) AS submitted_at, count(*) FILTER (own_task) AS tasks_started,
               count(*) FILTER (own_task AND ended) AS tasks_complete, bool_or(own AND over) AS complete
        FROM t WHERE own OR own_task GROUP BY job_id, stage_id""",
    "history_running": """
        SELECT user_id AS job_handle, event_type = 'signup' AS running FROM events
        WHERE event_type IN ('signup', 'purchase')
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "history_roundtrip": _history("'job_start' AS event")
    + " UNION ALL "
    + _history("'job_complete' AS event", "o_orderstatus <> 'O'"),
    "envelope_json": """
        SELECT CAST(o_orderkey AS VARCHAR) AS handle, o_orderstatus <> 'P' AS success,
               '{"outputDir":"results/' || o_orderkey || '","handle":' || o_orderkey ||
               CASE WHEN o_orderstatus = 'P'
                    THEN ',"trace":["' || array_to_string(string_split(o_orderpriority, '-'), '","')
                         || '"]' ELSE '' END || '}' AS data,
               '{"jobName":"' || o_orderpriority || '"}' AS options FROM orders""",
    "trace_line_counts": """
        SELECT page_id, length(lines) AS n_lines, md5(array_to_string(lines, '|')) AS digest
        FROM (SELECT page_id, string_split(replace(html, chr(9), '    '), chr(10)) AS lines
              FROM pages)""",
    "sql_join": """
        SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS spent
        FROM customer JOIN orders ON o_custkey = c_custkey
        JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""",
    "sql_anti_join": """
        SELECT o_orderkey, o_custkey FROM orders
        WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
    "sql_rollup": """
        SELECT l_returnflag, l_linestatus, count(*) AS n_lines,
               CAST(sum(l_quantity) AS BIGINT) AS quantity
        FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "sql_window": """
        SELECT o_custkey, o_orderkey, CAST(recency AS INTEGER) AS recency FROM (
          SELECT o_custkey, o_orderkey, row_number() OVER (
            PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS recency
          FROM orders) WHERE recency <= 3""",
    "sql_set_operations": """
        SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier
        EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0""",
}
