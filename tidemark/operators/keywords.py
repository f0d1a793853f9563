"""Keyword analytics: counts and means per keyword, sentiment, tone and region.

A *mention* is one keyword of one post. Mentions may carry a weight column, the
number of times the keyword occurs in the post, so that long texts are counted
per post before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import with_parts
from tidemark.operators.latest import best_per_group

from tidemark.functions.constants import WATCHED
from tidemark.functions.scalars import sentiment_value

# A longer list is joined as a table instead of being written into the plan.
_LITERAL_WORDS = 1000


def _is_table(watch) -> bool:
    return isinstance(watch, DataFrame) or (watch is not None and len(watch) > _LITERAL_WORDS)


def keep_watched(
    df: DataFrame, watch: Collection[str] | DataFrame | None, column: str
) -> DataFrame:
    """Rows whose ``column`` is in the watch list (exact match); without a list, all rows.

    A short list becomes a literal set. A long list or a one-column DataFrame is a
    left-semi join without a hint: Spark broadcasts it if its size allows.
    """
    if watch is None:
        return df
    if not _is_table(watch):
        return df.where(F.col(column).isin(list(watch)))
    if not isinstance(watch, DataFrame):
        watch = df.sparkSession.createDataFrame([(word,) for word in watch], "word string")
    listed = watch.select(F.col(watch.columns[0]).alias(column))
    return df.join(listed, column, "left_semi")


def mentions(
    posts: DataFrame, tags: str | Column, *keep: str | Column, watch=None
) -> DataFrame:
    """One row per keyword of a post: ``hashtag`` and the columns to keep.

    Posts with a null or empty keyword array give no row; a keyword that is
    repeated in a post gives a row each time.
    """
    # ``tags`` may be an expression: exploding it in place computes it once, while a column
    # made beforehand is computed again by the filter Spark infers for it.
    return keep_watched(posts.select(F.explode(tags).alias("hashtag"), *keep), watch, "hashtag")


def _weight(weight: str | None) -> Column:
    return F.count(F.lit(1)) if weight is None else F.sum(weight)


def count_mentions(rows: DataFrame, *keys: str, weight: str | None = None) -> DataFrame:
    """Mentions per group as ``total``; a null key is a group of its own."""
    return rows.groupBy(*keys).agg(_weight(weight).alias("total"))


def tone_sums(
    rows: DataFrame,
    tones: str | Column = "tones",
    sentiment: str = "sentiment",
    name: str = "tone_name",
    weight: str | None = None,
) -> DataFrame:
    """Score sums and counts per keyword, tone and sentiment.

    ``rows`` are mentions with an array of tones: each mention is paired with each tone
    of its own post.
    """
    n = F.lit(1) if weight is None else F.col(weight)
    paired = rows.select(
        "hashtag", F.col(sentiment).alias("sentiment"), n.alias("_n"), F.explode(tones).alias("_t")
    ).select("hashtag", "sentiment", "_n", F.col("_t").getField(name).alias("tone"), "_t.score")
    known = F.when(F.col("score").isNotNull(), F.col("_n"))
    return paired.groupBy("hashtag", "tone", "sentiment").agg(
        F.sum(F.col("score").cast("double") * F.col("_n")).alias("score_sum"),
        F.sum(known).alias("scored"),
        F.sum("_n").alias("total"),
    )


def tone_means(sums: DataFrame, strict: bool = True) -> DataFrame:
    """Mean score, mean sentiment and count per keyword and tone, from :func:`tone_sums`.

    Sentiments are looked up here, after all filters, so that an unknown one only fails
    where it counts. Leniently, it stays out of the mean sentiment.
    """
    value = sentiment_value(F.col("sentiment"), strict)
    valued = sums.withColumn("_value", value)
    known = F.when(F.col("_value").isNotNull(), F.col("total"))
    return valued.groupBy("hashtag", "tone").agg(
        (F.sum("score_sum") / F.sum("scored")).alias("mean_score"),
        (F.sum(F.col("_value") * F.col("total")) / F.sum(known)).alias("mean_sentiment"),
        F.sum("total").alias("total"),
    )


def keyword_sentiment_counts(
    posts: DataFrame,
    watch=WATCHED,
    tags: str = "entities.hashtags.text",
    sentiment: str = "tone.sentiment",
) -> DataFrame:
    """(hashtag, sentiment, total) in key order, null sentiments first."""
    early, late = _when_to_filter(watch)
    rows = mentions(posts, tags, F.col(sentiment).alias("sentiment"), watch=early)
    counts = keep_watched(count_mentions(rows, "hashtag", "sentiment"), late, "hashtag")
    return counts.orderBy("hashtag", "sentiment")


def keyword_tone_means(
    posts: DataFrame,
    watch=WATCHED,
    tags: str = "entities.hashtags.text",
    sentiment: str = "tone.sentiment",
    tones: str = "tone.document_tone.tones",
    strict: bool = True,
) -> DataFrame:
    """(hashtag, tone, mean_score, mean_sentiment, total) in key order."""
    early, late = _when_to_filter(watch)
    rows = mentions(
        posts, tags, F.col(sentiment).alias("sentiment"), F.col(tones).alias("tones"), watch=early
    )
    sums = keep_watched(tone_sums(rows), late, "hashtag")
    return tone_means(sums, strict).orderBy("hashtag", "tone")


def _when_to_filter(watch):
    """A literal list filters every mention. A table is joined to the groups instead, so
    that a frequent keyword is summed up before it is shuffled by keyword."""
    return (None, watch) if _is_table(watch) else (watch, None)


def popularity(rows: DataFrame, key: str = "hashtag", weight: str | None = None) -> DataFrame:
    """(total, key), least popular first; equal totals in key order."""
    return count_mentions(rows, key, weight=weight).select("total", key).orderBy("total", key)


def most_popular(rows: DataFrame, k: int, key: str = "hashtag") -> DataFrame:
    """The k keys with the most mentions."""
    return count_mentions(rows, key).orderBy(F.col("total").desc(), key).limit(k)


def top_per_region(counts: DataFrame, k: int, region: str, key: str = "hashtag") -> DataFrame:
    """The k most counted keys of each region, with their ``rank``.

    For any k; see :func:`.latest.best_per_group`.
    """
    return best_per_group(counts, [region], F.struct(-F.col("total"), F.col(key)), k)


def value_runs(rows: DataFrame, key: str, value: str) -> DataFrame:
    """All values of a key run together in value order, as (key, value, copies).

    One row per distinct value stands for ``copies`` repetitions, so no group is
    ever held in one row, whatever its size.
    """
    return rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(
        F.count(F.lit(1)).alias("copies")
    )


def run_positions(
    runs: DataFrame, key: str, value: str, copies: str = "copies", part_rows: int | None = None
) -> DataFrame:
    """The runs of :func:`value_runs` with their place in the text that a key's values make.

    ``start`` counts the characters of the runs before it, and ``n_chars`` all of the key. The
    sums run along within ranges of values; a key with more than a million runs has several of
    them, each of which goes on from the sum of those before it.
    """
    sized = runs.withColumnsRenamed({key: "_key", value: "_time"}).withColumn(
        "_size", F.length("_time").cast("long") * F.col(copies)
    )
    cut = with_parts(sized, ["_key"], part_rows)
    before = Window.partitionBy("_key", "_part").orderBy("_time")
    zero = F.lit(0).cast("long")
    within = F.coalesce(F.sum("_size").over(before.rowsBetween(Window.unboundedPreceding, -1)), zero)
    totals = cut.where("_is_cut").groupBy("_key", "_part").agg(F.sum("_size").alias("_total"))
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col("_key").alias("_c_key"), F.col("_part").alias("_c_part"), F.sum("_total").over(earlier).alias("_carry")
    )
    # One row per range of a key that has several.
    placed = cut.withColumn("_within", within).join(
        F.broadcast(carried), (F.col("_key") == F.col("_c_key")) & (F.col("_part") == F.col("_c_part")), "left"
    )
    lengths = sized.groupBy(F.col("_key").alias("_l_key")).agg(F.sum("_size").alias("n_chars"))
    return placed.join(lengths, F.col("_key").eqNullSafe(F.col("_l_key"))).select(
        *[F.col({key: "_key", value: "_time"}.get(name, name)).alias(name) for name in runs.columns],
        (F.col("_within") + F.coalesce("_carry", zero)).alias("start"),
        "n_chars",
    )


def text_slice(positions: DataFrame, value: str, low: int, high: int, copies: str = "copies") -> DataFrame:
    """The pieces (``start``, ``piece``) of one key's text between two characters, in order.

    A run is only repeated as far as the slice reaches, and runs outside of it are not read.
    """
    size = F.length(value).cast("long")
    end = F.col("start") + size * F.col(copies)
    first, last = F.greatest("start", F.lit(low)) - F.col("start"), F.least(end, F.lit(high)) - F.col("start")
    offset = first % size
    text = F.expr("repeat(_value, CAST(ceil((_offset + _n) / length(_value)) AS int))")
    return (
        positions.where((F.col("start") < high) & (end > low))
        .select((F.col("start") + first).alias("start"), F.col(value).alias("_value"), offset.alias("_offset"), (last - first).alias("_n"))
        .select("start", F.substring(text, F.col("_offset").cast("int") + 1, F.col("_n").cast("int")).alias("piece"))
        .orderBy("start")
    )
