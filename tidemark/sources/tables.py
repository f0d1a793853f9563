"""Tables by name, raw text datasets, and caching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def dataset(spark: SparkSession, name: str, limit: int | None = None) -> DataFrame:
    """All of a table, or ``limit`` rows of it."""
    table = spark.table(name)
    return table if limit is None else table.limit(limit)


def list_tables(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW TABLES")


def raw_dataset(
    spark: SparkSession, root: str, name: str, min_partitions: int | None = None
) -> DataFrame:
    """The lines (``value``) of all text files under ``root/name``.

    Repartitions only where the scan gives fewer partitions than asked for.
    """
    lines = spark.read.text(f"{root.rstrip('/')}/{name}/")
    if min_partitions and lines.rdd.getNumPartitions() < min_partitions:
        lines = lines.repartition(min_partitions)
    return lines


def cache_table(spark: SparkSession, name: str) -> None:
    spark.catalog.cacheTable(name)


def uncache_table(spark: SparkSession, name: str) -> None:
    spark.catalog.uncacheTable(name)
