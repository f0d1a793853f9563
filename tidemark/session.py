"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # Streaming state may outgrow the heap of an executor.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(app_name: str = "tidemark", **conf: str) -> SparkSession:
    """A session with the library defaults; master and sizes come from spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new path under ``spark.checkpoint.dir``, which every executor can reach."""
    return f"{_shared_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows computed once and kept in the shared folder, for results used several times.

    Parquet rather than a checkpoint of Spark's rows, which takes several times the disk.
    """
    path = shared_dir(df.sparkSession, "kept")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _shared_root(spark: SparkSession) -> str:
    """The shared folder of the session.

    A local session without the setting gets a temporary folder. On a cluster the
    setting is required, since a folder of one machine is lost with that machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _local_root()


@functools.lru_cache(maxsize=1)
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="tidemark-")
