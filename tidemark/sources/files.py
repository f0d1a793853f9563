"""Files that Python tasks open themselves, by the paths that Spark knows."""

from __future__ import annotations

import pyarrow.fs
from pyspark.sql import SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that the session's settings give it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a qualified path and the path within it."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return pyarrow.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pyarrow.fs.FileSystem.from_uri("s3:" + rest if scheme == "s3a" else path)
