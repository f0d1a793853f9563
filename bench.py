"""Times the headline queries; prints one JSON line.

Each query is run once to warm up and then ``BENCH_RUNS`` times (2 by default); its
time is the median, from building the DataFrame to the last row.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tidemark.plans.table_queries import QUERIES
from tidemark.session import build_session

HEADLINE = [
    "keyword_sentiment_counts",
    "keyword_tone_means",
    "json_sentiment_counts",
    "json_tone_means",
    "keyword_vocabulary_counts",
    "keyword_popularity",
    "top_keywords",
    "second_token_counts",
    "keyword_by_source",
    "top_keywords_per_source",
    "sql_script",
    "saved_result_roundtrip",
    "rows_as_strings",
    "progress_by_job",
    "latest_job_per_handle",
    "progress_by_handle",
    "retained_jobs",
    "owner_asof",
    "feed_progress",
    "feed_tasks",
    "event_counts_stream",
    "progress_stream",
    "history_running",
    "sql_join",
]


def seconds(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        seconds(QUERIES[name], spark, sf_dir)
        measured = [seconds(QUERIES[name], spark, sf_dir) for _ in range(runs)]
        times[name] = round(statistics.median(measured), 3)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
