"""The latest row of each key, the best rows of a group, and retention of the newest jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.constants import RETAINED_JOBS
from tidemark.operators.asof import with_parts

#: Up to so many rows per group each task cuts a group down before it is shuffled.
CUT_IN_TASKS = 1000


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` values per key; rows without a key are left out.

    An aggregate rather than a window: each task keeps one row per key before the shuffle.
    """
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())
    payload = F.struct(*[F.col(f"`{name}`") for name in rows.columns if name not in keys])
    best = rows.groupBy(*keys).agg(F.max_by(payload, F.struct(*order)).alias("_best"))
    return best.select(*keys, "_best.*").select(*rows.columns)


def best_per_group(
    rows: DataFrame, groups: list[str], key: Column, k: int, ascending: bool = True, part_rows: int | None = None
) -> DataFrame:
    """The first ``k`` rows of each group by ``key``, with their ``rank``; for any k and any group.

    For a small k a window does it, which each task cuts to k rows per group beforehand. For
    a large one a group with more than a million rows is cut into ranges of the
    key; the number of rows in each range tells how many stand before it, so that ranges
    behind the k-th row are left out unsorted and the others are ranked each by itself. Ties
    in the key are broken anyhow.
    """
    if k <= CUT_IN_TASKS:
        order = Window.partitionBy(*groups).orderBy(key.asc() if ascending else key.desc())
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # A key of its own for every row would be needed to cut among equal keys; those share a range.
    cut = with_parts(rows.withColumn("_time", key), groups, part_rows)
    part = F.col("_part") if ascending else -F.col("_part")
    named = {name: f"_s_{name}" for name in groups}
    before = Window.partitionBy(*named.values()).orderBy("_s_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*[F.col(n).alias(to) for n, to in named.items()], part.alias("_s_part")).agg(F.count(F.lit(1)).alias("_n"))
    ahead = sizes.withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_ahead") < k).drop("_n")
    same = [F.col(n).eqNullSafe(F.col(to)) for n, to in named.items()] + [part == F.col("_s_part")]
    within = Window.partitionBy(*groups, "_part").orderBy(F.col("_time").asc() if ascending else F.col("_time").desc())
    ranked = cut.join(ahead, same).withColumn("rank", (F.row_number().over(within) + F.col("_ahead")).cast("int"))
    return ranked.where(F.col("rank") <= k).select(*rows.columns, "rank")


def retained_jobs(
    jobs: DataFrame, keep: int = RETAINED_JOBS, app: str = "app_id", order=("started", "job_id")
) -> DataFrame:
    """Every incomplete job, and per application the newest completed ones up to ``keep`` in all.

    Completed jobs are cut to ``keep`` per application by :func:`best_per_group`; incomplete
    ones only pass through as a count. A single window over all jobs would read them once
    instead of three times, but would bring all incomplete jobs of an application into one task.
    """
    newest = F.struct(*[F.col(name) for name in order])
    candidates = best_per_group(jobs.where("complete"), [app], newest, keep, ascending=False)
    running = jobs.where("not complete")
    taken = running.groupBy(app).agg(F.count(F.lit(1)).alias("_running"))
    room = F.lit(keep) - F.coalesce(F.col("_running"), F.lit(0))
    kept = candidates.join(taken, app, "left").where(F.col("rank") <= room)
    return running.unionByName(kept.select(*jobs.columns))
