"""User jobs: plain callables ``job(spark)`` or ``job(spark, options)`` returning a DataFrame."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_JOBS: dict[str, Callable[..., DataFrame]] = {}


def job(name: str):
    """Decorator that registers a callable under a name."""

    def register(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _JOBS[name] = function
        return function

    return register


def job_names() -> list[str]:
    return sorted(_JOBS)


def run_job(spark: SparkSession, name: str, options: dict | None = None) -> DataFrame:
    """Runs a registered job; the options are passed if it takes a second argument."""
    function = _JOBS[name]
    if len(inspect.signature(function).parameters) > 1:
        return function(spark, options or {})
    return function(spark)
