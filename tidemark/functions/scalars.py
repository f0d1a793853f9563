"""Small column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.constants import SENTIMENT_VALUES

_BLANKS = " \t\n\x0b\f\r"
_NULL_MARK = r"\N"


def first_tokens(text: Column, count: int) -> Column:
    """The first ``count`` tokens of whitespace-separated text and, if any, the rest as one."""
    return F.split(F.trim(text, F.lit(_BLANKS)), r"[ \t\n\x0B\f\r]+", count + 1)


def token(text: Column, position: int) -> Column:
    """The token at ``position`` (from 0), else null."""
    found = F.get(first_tokens(text, position + 1), F.lit(position))
    # Blank text has one empty token and no other.
    return found if position else F.nullif(found, F.lit(""))


def words(text: Column) -> Column:
    """Text split at single blanks."""
    return F.split(text, " ")


def sentiment_value(sentiment: Column, strict: bool = True) -> Column:
    """The number of a sentiment; an unknown or missing one fails, or is null if lenient."""
    pairs = [F.lit(x) for pair in SENTIMENT_VALUES.items() for x in pair]
    value = F.create_map(*pairs)[sentiment]
    if not strict:
        return value
    shown = F.coalesce(sentiment, F.lit("null"))
    return F.coalesce(value, F.raise_error(F.concat(F.lit("unknown sentiment: "), shown)))


def progress(done: Column, total: Column) -> Column:
    """done / total as a double; a total of zero counts as finished."""
    return F.when(total == 0, F.lit(1.0)).otherwise(
        done.cast("double") / F.nullif(total, F.lit(0)).cast("double")
    )


def at_least_one(count: Column, total: Column) -> Column:
    """``count``, or 1 where there is nothing to count."""
    return F.when(total == 0, F.lit(1).cast("long")).otherwise(count)


def property_or_blank(properties: Column, key: str) -> Column:
    """A map entry, or the empty string where map or key is missing."""
    return F.coalesce(properties[key], F.lit(""))


def has_property(properties: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(properties, key), F.lit(False))


def trace_lines(trace: Column) -> Column:
    """A stack trace as an array of lines, each tab shown as four blanks."""
    return F.split(F.replace(trace, F.lit("\t"), F.lit("    ")), "\n")


def now_millis() -> Column:
    return F.unix_millis(F.current_timestamp())


def wall_micros(time: Column) -> Column:
    """Microseconds of a timestamp without zone since 1970 on the same clock.

    From its calendar fields, since a cast would go through the session time zone.
    """
    days = F.unix_date(time.cast("date")).cast("long")
    seconds = F.hour(time) * 3600 + F.minute(time) * 60 + F.extract(F.lit("SECOND"), time)
    return days * 86_400_000_000 + (seconds * 1_000_000).cast("long")


def fields(line: Column) -> Column:
    """The tab-separated fields of a line."""
    return F.split(line, "\t")


def escape_field(value: Column) -> Column:
    """A string made safe for a tab-delimited line; null becomes an unescaped ``\\N``."""
    safe = value
    for char, mark in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        safe = F.replace(safe, F.lit(char), F.lit(mark))
    return F.coalesce(safe, F.lit(_NULL_MARK))


def unescape_field(value: Column) -> Column:
    """The inverse of :func:`escape_field`."""

    def undo(piece: Column) -> Column:
        for mark, char in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
            piece = F.replace(piece, F.lit(mark), F.lit(char))
        return piece

    # Cut at escaped backslashes first, so that what follows one is left alone.
    pieces = F.split(value, r"\\\\")
    restored = F.array_join(F.transform(pieces, undo), "\\")
    return F.when(value == _NULL_MARK, None).when(value.contains("\\"), restored).otherwise(value)
