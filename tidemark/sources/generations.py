"""Tables kept as folders of batches and generations, each replaced as a whole.

``batch=N`` holds what batch N adds and ``gen=N`` all batches up to N merged. A folder counts
once its writing has ended, so a reader takes the newest whole generation and the batches
after it, and a batch that is written again replaces itself.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_FOLDER = re.compile(r"(batch|gen)=(\d+)$")


def _folders(spark: SparkSession, table: str) -> list[tuple[str, int]]:
    """(kind, number) of the whole folders of a table."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(table)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [_FOLDER.match(status.getPath().getName()) for status in files.listStatus(root)]
    found = [(m[1], int(m[2])) for m in names if m]
    return [(k, n) for k, n in found if files.exists(hadoop.Path(f"{table}/{k}={n}/_SUCCESS"))]


def write(rows: DataFrame, table: str, kind: str, number: int) -> None:
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{table}/{kind}={number}")


def current(spark: SparkSession, table: str, upto: int | None = None) -> list[str]:
    """The folders that hold the table as of a batch, or as it is now."""
    found = [(k, n) for k, n in _folders(spark, table) if upto is None or n <= upto]
    mark = max((n for k, n in found if k == "gen"), default=-1)
    parts = sorted(n for k, n in found if k == "batch" and n > mark)
    return [f"{table}/gen={mark}"] * (mark >= 0) + [f"{table}/batch={n}" for n in parts]


def read(spark: SparkSession, table: str, schema, upto: int | None = None) -> DataFrame:
    folders = current(spark, table, upto)
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def forget(spark: SparkSession, table: str, mark: int) -> None:
    """Removes what the generation ``mark`` has made superfluous, but for the one before it.

    A reader that began with the generation before can so end undisturbed.
    """
    found = _folders(spark, table)
    older = max((n for k, n in found if k == "gen" and n < mark), default=None)
    if older is None:
        return
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(table).getFileSystem(spark._jsc.hadoopConfiguration())
    for kind, n in found:
        if n < older or (kind == "batch" and n == older):
            files.delete(hadoop.Path(f"{table}/{kind}={n}"), True)
