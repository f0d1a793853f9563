"""Scans of Spark event logs (uncompressed, one JSON event per line)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import EVENT
from tidemark.sources.files import qualified
from tidemark.sources.live_logs import FORMAT, RUNNING, SLICE_BYTES, LiveLogs


def read_events(spark: SparkSession, path: str, app_id: str | None = None) -> DataFrame:
    """Events with their application id; lines that are no event are dropped.

    A log file is named after its application (a rolled one after a prefix with its
    number, one still written to with ``.inprogress`` at its end), so that a folder of
    single, rolled and running logs can be read at once. ``app_id`` replaces the file name
    where a feed of one application is spread over other files.
    """
    reader = spark.read.schema(EVENT).option("recursiveFileLookup", "true")
    return _with_app(reader.json(path), app_id)


def stream_events(
    spark: SparkSession, path: str, app_id: str | None = None, files_per_trigger: int | None = None
) -> DataFrame:
    """The same as a stream over the complete files that arrive in a folder.

    A file is read once, so one that is still written to is left out until its ``.inprogress``
    is gone. :func:`follow_logs` reads running logs.
    """
    reader = spark.readStream.schema(EVENT).option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    complete = ~F.col("_metadata.file_name").endswith(RUNNING)
    return _with_app(reader.json(path).where(complete), app_id)


def follow_logs(
    spark: SparkSession, path: str, app_id: str | None = None, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """The events of a folder of logs that grow, roll and are renamed, as a stream.

    Each line is read once, as soon as its line feed is written; see :mod:`.live_logs`.
    """
    spark.dataSource.register(LiveLogs)
    reader = spark.readStream.format(FORMAT).option("sliceBytes", slice_bytes)
    lines = reader.load(qualified(spark, path))
    of_log = F.regexp_replace("log", r"^(.*/)?(events_\d+_)?|\.gz$", "")
    app = of_log if app_id is None else F.lit(app_id)
    # A generator, through which the filter is not moved, so that a line is parsed once.
    events = lines.select(F.inline(F.array(F.from_json("line", EVENT))), app.alias("app_id"))
    return events.where(F.col("Event").isNotNull())


def write_events(events: DataFrame, path: str) -> None:
    """The feed as parquet with a folder per kind of event.

    The rollups look at the few job events several times and at the many task events
    once; written so, each reads only its own kinds and columns, and no JSON.
    """
    events.write.mode("append").option("compression", "zstd").partitionBy("Event").parquet(path)


def _with_app(events: DataFrame, app_id: str | None) -> DataFrame:
    # The empty ``appstatus`` file beside a rolled log has no events.
    of_file = F.regexp_replace(F.col("_metadata.file_name"), r"^events_\d+_|\.inprogress$", "")
    app = of_file if app_id is None else F.lit(app_id)
    return events.select("*", app.alias("app_id")).where(F.col("Event").isNotNull())
