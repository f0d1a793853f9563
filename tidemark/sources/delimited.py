r"""Saved results: tab-delimited text, sorted CSV, and JSON or parquet records.

In tab-delimited text a backslash, tab, line feed or carriage return inside a value
is written as ``\\``, ``\t``, ``\n`` or ``\r``, null as a bare ``\N``, and nested
values as JSON, so that any result can be read back unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.constants import DELIMITER
from tidemark.functions.scalars import escape_field, fields, unescape_field

# Keeps microseconds and the zone of timestamps inside nested values.
_JSON = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
_NESTED = (T.StructType, T.ArrayType, T.MapType)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _as_text(field: T.StructField) -> Column:
    column = _quoted(field.name)
    if isinstance(field.dataType, _NESTED):
        return F.to_json(column, _JSON)
    if isinstance(field.dataType, T.BinaryType):
        return F.base64(column)
    return column.cast("string")


def _from_text(text: Column, field: T.StructField) -> Column:
    if isinstance(field.dataType, _NESTED):
        value = F.from_json(text, field.dataType, _JSON)
    elif isinstance(field.dataType, T.BinaryType):
        value = F.unbase64(text)
    else:
        value = text.cast(field.dataType)
    return value.alias(field.name)


def as_strings(df: DataFrame) -> DataFrame:
    """Every column as a string, nested ones as JSON."""
    return df.select(*[_as_text(field).alias(field.name) for field in df.schema])


def as_lines(df: DataFrame) -> DataFrame:
    """Every row as one tab-delimited line (``value``)."""
    cells = [escape_field(_as_text(field)) for field in df.schema]
    return df.select(F.concat_ws(DELIMITER, *cells).alias("value"))


def from_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows that :func:`as_lines` wrote."""
    cells = lines.select(fields(F.col("value")).alias("_cells"))
    return cells.select(
        *[
            _from_text(unescape_field(F.get("_cells", F.lit(i))), field)
            for i, field in enumerate(schema)
        ]
    )


def save_delimited(df: DataFrame, path: str) -> None:
    as_lines(df).write.text(path)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return from_lines(spark.read.option("lineSep", "\n").text(path), schema)


def result_columns(df: DataFrame) -> DataFrame:
    """(position, name, type, nullable) of a result's columns."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(
        rows, "position int, name string, type string, nullable boolean"
    )


def save_sorted_csv(df: DataFrame, path: str, keys: list[str]) -> None:
    """Headerless comma CSV with CRLF line ends, in key order across the part files.

    A small result comes out as one file, since adaptive execution merges small
    partitions of the sort; a large one keeps its ranges, one file each.
    """
    df.orderBy(*keys).write.option("lineSep", "\r\n").csv(path)


def append_records(df: DataFrame, path: str, *partition_by: str) -> None:
    """Appends run-history rows as parquet."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def append_envelopes(df: DataFrame, path: str) -> None:
    """Appends run outcomes as JSON lines."""
    df.write.mode("append").json(path)
