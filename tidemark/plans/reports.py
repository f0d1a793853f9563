"""The keyword reports, from posts on disk to a result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.constants import WATCHED
from tidemark.functions.scalars import first_tokens
from tidemark.operators.keywords import (
    count_mentions,
    keyword_sentiment_counts,
    keyword_tone_means,
    mentions,
    popularity,
    top_per_region,
)
from tidemark.sources.delimited import save_sorted_csv
from tidemark.sources.posts import SENTIMENT_POST, TAG_TEXT_POST, TONE_POST, read_posts


def sentiment_report(spark: SparkSession, path: str, out: str, watch=WATCHED) -> None:
    """Counts per keyword and sentiment as CSV."""
    counts = keyword_sentiment_counts(read_posts(spark, path, SENTIMENT_POST), watch)
    save_sorted_csv(counts, out, ["hashtag", "sentiment"])


def tone_report(
    spark: SparkSession, path: str, out: str, watch=WATCHED, strict: bool = True
) -> None:
    """Mean score and mean sentiment per keyword and tone as CSV."""
    means = keyword_tone_means(read_posts(spark, path, TONE_POST), watch, strict=strict)
    save_sorted_csv(means, out, ["hashtag", "tone"])


def tag_text_mentions(posts: DataFrame, tags: str = "hashtags", *keep: str) -> DataFrame:
    """The second token of a blank-separated tag text; posts with fewer tokens give no row."""
    # At most one row per post; a null test on the token would split the text again.
    second = F.slice(first_tokens(F.col(tags), 2), 2, 1)
    return mentions(posts, second, *keep)


def popularity_report(spark: SparkSession, path: str) -> DataFrame:
    """How often each tag occurs, least popular first."""
    return popularity(tag_text_mentions(read_posts(spark, path, TAG_TEXT_POST)))


def region_report(
    spark: SparkSession, path: str, region: str = "state", k: int | None = None
) -> DataFrame:
    """How often each tag occurs per region, or only the k most popular of each."""
    posts = read_posts(spark, path, TAG_TEXT_POST)
    counts = count_mentions(tag_text_mentions(posts, "hashtags", region), region, "hashtag")
    return counts if k is None else top_per_region(counts, k, region)
