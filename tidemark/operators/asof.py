"""As-of join: each left row meets the latest right row of its key that is not later.

One lazy plan for any number of rows per key. Where a key has few right rows, as a stage that
few jobs list, they become one short array, which the left rows of the key meet in one join;
each takes the last entry that is not later. Keys with more are found by the number of their
right rows and marked by a bounded number of hashes; all rows of such a hash go another way:

1. Left rows are reduced to the different (key, time) they have and right rows to the best of
   each (key, time), in one aggregation. However many rows share an instant, it is one row.
2. A key with more than a million instants is cut into parts by time. The cuts are quantiles
   of a sample chosen by the hash of (key, time), so that they come out the same whenever they
   are computed.
3. Within each part the latest right row runs along in time. A part of a cut key goes on
   from the latest right row of the parts before it; there is one such row for each part.
4. The left rows are joined to their instants. Of an instant that a large share of them has,
   Spark splits the left rows over tasks by its handling of skewed joins.

Left rows are shuffled once either way: for the first join, or for the last one, and carry
nothing through the others. Where no key has many right rows, nothing is read for the second way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Instants of a key that one task takes; a key with more is cut. One row for so many
#: instants is broadcast, some tens of bytes each.
HOT_ROWS = 1_000_000
#: Sampled instants for each part of a cut key.
CUT_SAMPLE = 200
#: Rows of a crowded key that are counted, at least.
CROWD_SAMPLE = 1000
#: Right rows of a key that one array holds.
FEW_ROWS = 32
#: Hashes by which keys with more are marked; at most so many short rows are broadcast.
BUSY_HASHES = 1 << 16


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_time: str,
    right_time: str,
    right_tie: str | None = None,
    how: str = "inner",
    part_rows: int | None = None,
) -> DataFrame:
    """As-of join; among right rows of one time the largest ``right_tie`` wins.

    Both sides share the ``on`` columns and no other name. Null keys and times match nothing:
    such left rows are dropped, or kept without a match if ``how`` is ``left``. ``part_rows``
    are the instants of a key that one task takes, ``HOT_ROWS`` by default.
    """
    extra = [name for name in right.columns if name not in on]
    kept, matched = left, right
    for name in [*on, right_time]:
        matched = matched.where(F.col(f"`{name}`").isNotNull())
    if how != "left":
        for name in [*on, left_time]:
            kept = kept.where(F.col(f"`{name}`").isNotNull())
    # At most BUSY_HASHES rows of one number.
    busy = F.broadcast(_busy_hashes(matched, on))

    def rows(of: DataFrame, side: str) -> DataFrame:
        return of.join(busy, _hash(on) == F.col("_busy"), side)

    few = _from_few(rows(kept, "left_anti"), rows(matched, "left_anti"), on, left_time, right_time, right_tie, extra, how)
    many = _from_many(
        rows(kept, "left_semi"), rows(matched, "left_semi"), on, left_time, right_time, right_tie, extra, how, part_rows
    )
    return few.unionByName(many)


def _hash(on: list[str]) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{name}`") for name in on]), F.lit(BUSY_HASHES)).cast("int")


def _busy_hashes(right: DataFrame, on: list[str]) -> DataFrame:
    """The hashes of the keys that have more than FEW_ROWS right rows."""
    counts = right.groupBy(*[F.col(f"`{name}`") for name in on]).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > FEW_ROWS).select(_hash(on).alias("_busy")).distinct()


def _from_few(left, right, on, left_time, right_time, right_tie, extra, how) -> DataFrame:
    """The join where each key has at most FEW_ROWS right rows, as an array in order of time."""
    tie = F.struct(F.col(f"`{right_tie}`") if right_tie else F.lit(0))
    row = F.struct(*[F.col(f"`{name}`") for name in extra])
    keys = [F.col(f"`{name}`") for name in on]
    order = F.struct(F.col(f"`{right_time}`").alias("time"), tie.alias("tie"))
    entries = right.select(*keys, F.struct(order.alias("at"), row.alias("row")).alias("_entry"))
    # The hash in the key keeps this partitioning from that of the join, so that Spark may split
    # a key with many left rows over tasks.
    arrays = entries.groupBy(*keys, _hash(on).alias("_busy")).agg(F.collect_list("_entry").alias("_entries"))

    def earlier(a: Column, b: Column) -> Column:
        return F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)

    owners = arrays.select(*keys, F.array_sort("_entries", earlier).alias("_entries"))
    here, there = left.alias("l"), owners.alias("f")
    match = [F.col(f"l.`{name}`") == F.col(f"f.`{name}`") for name in on]
    until = F.filter("f._entries", lambda e: e["at"]["time"] <= F.col(f"l.`{left_time}`"))
    # A generator, through which no filter on the entry is moved below the join.
    joined = here.join(there, match, how).select(
        *[F.col(f"l.`{name}`") for name in left.columns], F.explode_outer(F.slice(until, -1, 1)).alias("_entry")
    )
    if how != "left":
        joined = joined.where(F.col("_entry").isNotNull())
    return joined.select(*[F.col(f"`{name}`") for name in left.columns], *[F.col(f"_entry.row.`{name}`") for name in extra])


def _from_many(left, right, on, left_time, right_time, right_tie, extra, how, part_rows) -> DataFrame:
    """The join for any number of right rows, by instants."""
    found = _owners_of_instants(left, right, on, left_time, right_time, right_tie, extra, part_rows)
    here, there = left.alias("l"), found.alias("f")
    match = [F.col(f"l.`{name}`") == F.col(f"f.`{name}`") for name in on]
    match.append(F.col(f"l.`{left_time}`") == F.col("f._time"))
    return here.join(there, match, how).select(
        *[F.col(f"l.`{name}`") for name in left.columns], *[F.col(f"f._r.`{name}`") for name in extra]
    )


def _owners_of_instants(left, right, on, left_time, right_time, right_tie, extra, part_rows) -> DataFrame:
    """(on, _time, _r) of each different instant of the left side that has an owner."""
    rows = _instants(left, right, on, left_time, right_time, right_tie, extra)
    cut = with_parts(rows, on, part_rows)
    order = Window.partitionBy(*on, "_part").orderBy("_time")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = cut.withColumn("_r", F.last("_r", ignorenulls=True).over(running)).where("_wanted")
    carried = _carried(cut, on).select(*[F.col(name).alias(f"_c_{name}") for name in on], F.col("_part").alias("_c_part"), "_carry")
    same = [F.col(name) == F.col(f"_c_{name}") for name in on] + [F.col("_part") == F.col("_c_part")]
    # One row per part of a cut key.
    found = own.join(F.broadcast(carried), same, "left").withColumn("_r", F.coalesce("_r", "_carry"))
    return found.where(F.col("_r").isNotNull()).select(*on, "_time", "_r")


def _instants(left, right, on, left_time, right_time, right_tie, extra) -> DataFrame:
    """(on, _time, _r, _wanted): each instant once, with its best right row if it has one."""
    row = F.struct(*[F.col(f"`{name}`") for name in extra])
    # A struct, since a tie that is null still is a row.
    tie = F.struct(F.col(f"`{right_tie}`") if right_tie else F.lit(0))
    keys = [F.col(f"`{name}`").alias(name) for name in on]
    rights = right.select(*keys, F.col(f"`{right_time}`").alias("_time"), tie.alias("_tie"), row.alias("_r"), F.lit(False).alias("_wanted"))
    types = rights.schema
    lefts = left.select(
        *keys,
        F.col(f"`{left_time}`").alias("_time"),
        F.lit(None).cast(types["_tie"].dataType).alias("_tie"),
        F.lit(None).cast(types["_r"].dataType).alias("_r"),
        F.lit(True).alias("_wanted"),
    )
    rows = lefts.unionByName(rights)
    for name in [*on, "_time"]:
        rows = rows.where(F.col(name).isNotNull())
    return rows.groupBy(*on, "_time").agg(F.max_by("_r", "_tie").alias("_r"), F.max("_wanted").alias("_wanted"))


def along(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, right_tie: str) -> DataFrame:
    """Left and right rows of each key together in order of time, shuffled once each.

    Has the columns of both sides, null for the other; ``_right`` tells the side, and ``_at`` has
    time and tie of the latest right row that is not later, null where there is none. All of a key
    is sorted in one task, which needs disk but no memory for it; :func:`crowded` tells the keys
    that should go through :func:`asof_join`.
    """
    ordered = in_order(together(left, right, on, left_time, right_time), on, right_tie)
    times = {left_time: F.when(~F.col("_right"), F.col("_time")), right_time: F.when(F.col("_right"), F.col("_time"))}
    return ordered.withColumns(times).drop("_time")


def together(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str) -> DataFrame:
    """Both sides with one ``_time``, and ``_right`` that tells the side."""

    def slim(side: DataFrame, time: str, is_right: bool) -> DataFrame:
        keys = [F.col(f"`{name}`") for name in on]
        rest = [F.col(f"`{name}`") for name in side.columns if name not in (*on, time)]
        return side.select(*keys, F.col(f"`{time}`").alias("_time"), *rest, F.lit(is_right).alias("_right"))

    return slim(left, left_time, False).unionByName(slim(right, right_time, True), allowMissingColumns=True)


def in_order(both: DataFrame, on: list[str], right_tie: str) -> DataFrame:
    """Adds ``_at`` of :func:`along` to rows of :func:`together`."""
    keys = [F.col(f"`{name}`") for name in on]
    is_start = F.col("_right") & F.col("_time").isNotNull()
    for key in keys:
        is_start = is_start & key.isNotNull()
    order = Window.partitionBy(*keys).orderBy("_time", F.col("_right").desc(), F.col(f"`{right_tie}`"))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(is_start, F.struct(F.col("_time").alias("time"), F.col(f"`{right_tie}`").alias("tie")))
    return both.withColumn("_at", F.last(mark, ignorenulls=True).over(running))


def crowded(sides: list[DataFrame], on: list[str], part_rows: int | None = None) -> DataFrame:
    """The keys with more than ``part_rows`` rows, about, by a count of rows chosen by their hash.

    At most one key for each ``part_rows`` of the rows.
    """
    part_rows = part_rows or HOT_ROWS
    every = max(1, part_rows // CROWD_SAMPLE)
    chosen = None
    for side in sides:
        hashed = F.pmod(F.xxhash64(*[F.col(f"`{name}`") for name in side.columns]), F.lit(every)) == 0
        keys = side.where(hashed).select(*[F.col(f"`{name}`") for name in on])
        chosen = keys if chosen is None else chosen.unionByName(keys)
    counts = chosen.groupBy(*[F.col(f"`{name}`") for name in on]).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") * every > part_rows).drop("_n")


def hot_keys(rows: DataFrame, on: list[str], part_rows: int) -> DataFrame:
    """Keys with more than ``part_rows`` rows: ``_n`` rows each, to be cut into ``_copies`` parts."""
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > part_rows).withColumn("_copies", F.ceil(F.col("_n") / part_rows).cast("int"))


def cuts(rows: DataFrame, on: list[str], part_rows: int) -> DataFrame:
    """(on, _cuts): times that split the instants of each hot key into about equal parts.

    A sample by hash is the same set of instants in any run, so no cut depends on where or
    how often it is computed. It holds some ``CUT_SAMPLE`` instants for each part.
    """
    hot = hot_keys(rows, on, part_rows).select(*[F.col(name).alias(f"_h_{name}") for name in on], "_n", "_copies")
    same = [F.col(name) == F.col(f"_h_{name}") for name in on]
    every = F.greatest(F.lit(1), F.floor(F.col("_n") / (F.col("_copies") * CUT_SAMPLE)))
    # At most one row for each ``part_rows`` of the rows.
    sampled = rows.join(F.broadcast(hot), same).where(F.pmod(F.xxhash64(*on, "_time"), every) == 0)
    times = sampled.groupBy(*on).agg(F.sort_array(F.collect_list("_time")).alias("_times"), F.first("_copies").alias("_copies"))
    at = F.sequence(F.lit(1), F.greatest(F.col("_copies") - 1, F.lit(1)))
    places = F.transform(at, lambda i: F.floor(i * F.size("_times") / F.col("_copies")).cast("int"))
    picked = F.transform(places, lambda i: F.get("_times", i))
    return times.select(*on, F.filter(picked, lambda t: t.isNotNull()).alias("_cuts"))


def with_parts(rows: DataFrame, on: list[str], part_rows: int | None = None) -> DataFrame:
    """Adds ``_part``: 0 for ordinary keys, else the number of cuts that are not later."""
    found = cuts(rows, on, part_rows or HOT_ROWS).select(*[F.col(name).alias(f"_k_{name}") for name in on], "_cuts")
    same = [F.col(name) == F.col(f"_k_{name}") for name in on]
    before: Column = F.size(F.filter("_cuts", lambda t: t <= F.col("_time")))
    marked = rows.join(F.broadcast(found), same, "left")
    return marked.select(*rows.columns, F.when(F.col("_cuts").isNull(), 0).otherwise(before).alias("_part"), F.col("_cuts").isNotNull().alias("_is_cut"))


def _carried(cut: DataFrame, on: list[str]) -> DataFrame:
    """(on, _part, _carry): the latest right row before each part of a cut key that has one."""
    newest = F.when(F.col("_r").isNotNull(), F.col("_time"))
    lasts = cut.where("_is_cut").groupBy(*on, "_part").agg(F.max_by("_r", newest).alias("_r"))
    before = Window.partitionBy(*on).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return lasts.select(*on, "_part", F.last("_r", ignorenulls=True).over(before).alias("_carry")).where(F.col("_carry").isNotNull())
