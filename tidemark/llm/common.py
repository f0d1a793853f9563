"""Helpers that several operators share: words, single evaluation, written intermediates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_dir

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed, return.
WORD_GAP = r"[ \t-\r]+"
#: Rows that a broadcast may have; a side with more is left to a shuffled join.
BROADCAST_ROWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where the optimizer inlines columns."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """All words of a text, in order; none of a null text."""
    text = F.coalesce(text, F.lit(""))
    # A split by one character needs no regular expression; tabs and the like are rare.
    odd = F.lit(False)
    for gap in "\t\x0b\x0c\r":
        odd = odd | F.contains(text, F.lit(gap))
    plain = F.when(odd, F.regexp_replace(text, WORD_GAP, " ")).otherwise(F.replace(text, F.lit("\n"), F.lit(" ")))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case, any other letter as it is."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(
        F.translate(word, UPPER, LOWER)
    )


def stored(df: DataFrame, purpose: str, by: list[str] | None = None) -> DataFrame:
    """The rows written once to the shared folder and read again; cuts the lineage.

    ``by`` names columns whose values become folders, so that a reader of one value reads
    no other rows.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.partitionBy(*by or ()).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it is counted to have few rows, else as it is.

    For stored frames of narrow rows only, so that rows bound bytes and counting is cheap.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
