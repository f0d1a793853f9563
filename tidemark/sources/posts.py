"""Scans of line-delimited JSON posts.

Any path Spark can read works, object stores included; credentials come from the
provider chain of the cluster, never from code. A malformed line gives nulls, which
the keyword operators drop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.schemas import SENTIMENT_POST, TAG_TEXT_POST, TONE_POST

__all__ = ["SENTIMENT_POST", "TAG_TEXT_POST", "TONE_POST", "read_posts"]


def read_posts(
    spark: SparkSession, path: str, schema: str = TONE_POST, view: str | None = None
) -> DataFrame:
    """Posts with an explicit schema, optionally registered as a SQL view."""
    posts = spark.read.schema(schema).json(path)
    if view is not None:
        posts.createOrReplaceTempView(view)
    return posts
