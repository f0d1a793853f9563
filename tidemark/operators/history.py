"""Append-only run history and run outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, COMPLETE = "job_start", "job_complete"


def history_events(
    runs: DataFrame,
    event: str,
    account: Column,
    user: Column,
    handle: Column,
    job_type: Column | None = None,
    job_id: Column | None = None,
    data: Column | None = None,
    ts: Column | None = None,
) -> DataFrame:
    """One history record per row of ``runs``; ``data`` is a struct or map stored as JSON."""
    text = F.lit("{}") if data is None else F.to_json(data)
    return runs.select(
        account.cast("string").alias("account_id"),
        user.cast("string").alias("user_id"),
        F.lit(event).alias("event"),
        (F.lit("spark") if job_type is None else job_type).cast("string").alias("job_type"),
        (F.lit(None) if job_id is None else job_id).cast("string").alias("job_id"),
        handle.cast("string").alias("job_handle"),
        text.alias("data"),
        (F.current_timestamp() if ts is None else ts).cast("timestamp").alias("ts"),
    )


def run_state(
    history: DataFrame, order=("ts",), handle: str = "job_handle", event: str = "event"
) -> DataFrame:
    """Per handle whether it is ``running``: it has a start and no later completion."""
    at = F.struct(*order)
    last_start = F.max(F.when(F.col(event) == START, at))
    last_end = F.max(F.when(F.col(event) == COMPLETE, at))
    return (
        history.where(F.col(event).isin(START, COMPLETE))
        .groupBy(handle)
        .agg(last_start.alias("_start"), last_end.alias("_end"))
        .select(
            handle,
            F.coalesce(
                F.col("_start").isNotNull()
                & (F.col("_end").isNull() | (F.col("_start") > F.col("_end"))),
                F.lit(False),
            ).alias("running"),
        )
    )


def envelopes(
    runs: DataFrame, handle: Column, success: Column, data: Column, options: Column
) -> DataFrame:
    """One outcome record per run; ``data`` and ``options`` become JSON text."""
    return runs.select(
        handle.cast("string").alias("handle"),
        success.alias("success"),
        F.to_json(data).alias("data"),
        F.to_json(options).alias("options"),
    )
