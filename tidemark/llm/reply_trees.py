"""Reply trees: root-to-leaf paths, ranked by score, each chosen one formatted as a conversation.

Messages name their parent. Self-joins double the reach of every message's ancestor
pointer, so a path of any length takes as many joins as its length has binary digits; the
path of a leaf is then read off those pointers, each ancestor once. Branches of a tree
are ranked by the mean score of their messages, then length, then leaf.

A turn is ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line feed. In texts a
backslash is doubled and ``<|`` becomes ``<\\|``, so no text can hold a control string and
reading back restores it exactly. Roles are URL-encoded. The loss mask has one flag
per segment of the formatted conversation; it covers the texts of assistant turns.

Defined results: a null text or role is empty; messages of a tree that name a missing parent
or none are roots; messages that are not reachable from a root (cycles) are on no path; rows alike in every column are
told apart by the caller's node ids; a null tree id is a tree of its own; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import let, stored

START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, up) for every message on the path of every leaf, ``up`` steps above it.

    ``messages``: tree, node (not null, distinct in its tree) and parent.
    """
    nodes = messages.select("tree", "node", "parent")
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    pointer = nodes.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")))
    pointer = stored(pointer.select("tree", "node", F.col("parent").alias("above")), "parents")
    parents = pointer.select(F.col("tree").alias("t"), F.col("above").alias("n")).distinct()
    leaves = nodes.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti")

    jumps, at_most = [], nodes.count()
    while not pointer.isEmpty() and 2 ** len(jumps) <= at_most:
        jumps.append(pointer)
        far = pointer.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("above").alias("far"))
        pointer = stored(
            pointer.join(far, F.col("tree").eqNullSafe(F.col("t")) & (F.col("above") == F.col("n"))).select(
                "tree", "node", F.col("far").alias("above")
            ),
            "pointers",
        )
    found = stored(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("up")), "leaves")
    for k in reversed(range(len(jumps))):
        jump = jumps[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "above")
        higher = found.join(jump, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select(
            "tree", "leaf", F.col("above").alias("node"), (F.col("up") + 2**k).alias("up")
        )
        found = stored(found.unionByName(higher), "paths")
    return found


def conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, rank, n_turns, segments, formatted) of the best branches of every tree.

    ``messages``: tree, node, parent, role, text, score. ``segments`` are structs of a
    piece of the formatted text and whether it is under the loss mask.
    """
    said = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text", "score")
    on_path = paths(messages)
    scored = on_path.join(said.select("t", "n", "score"), F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    ranked = scored.groupBy("tree", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("mean"), F.count("*").alias("n_turns"))
    # The best branches come first in a sorted list cut to their number while it is made.
    order = F.struct((-F.col("mean")).alias("mean"), (-F.col("n_turns")).alias("turns"), F.col("leaf").alias("leaf"))
    chosen = ranked.select("tree", "leaf", "n_turns", order.alias("o"))
    if branches == 1:
        best = chosen.groupBy("tree").agg(F.min("o").alias("o")).select("tree", "o.leaf", F.lit(1).alias("rank"))
    else:
        from pyspark.sql import Window

        rank = F.row_number().over(Window.partitionBy("tree").orderBy("o"))
        best = chosen.withColumn("rank", rank).filter(F.col("rank") <= branches).select("tree", "leaf", "rank")
    best = best.select(F.col("tree").alias("bt"), F.col("leaf").alias("bl"), "rank")
    kept = on_path.join(best, F.col("tree").eqNullSafe(F.col("bt")) & (F.col("leaf") == F.col("bl")))
    turns = kept.join(said, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    turn = F.struct(
        (-F.col("up")).alias("at"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    gathered = turns.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def segments(t: Column) -> Column:
        head = F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n"))
        return F.array(
            F.struct(head.alias("piece"), F.lit(False).alias("loss")),
            F.struct(escaped(t["text"]).alias("piece"), (t["role"] == "assistant").alias("loss")),
            F.struct(F.lit(END).alias("piece"), F.lit(False).alias("loss")),
        )

    return gathered.select(
        "tree",
        "leaf",
        "rank",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["piece"]), ""))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")

    def turn(part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        role = F.replace(head, F.lit(START), F.lit(""))
        return F.struct(
            F.url_decode(role).alias("role"),
            unescaped(F.substr(part, F.length(head) + 2)).alias("text"),
        )

    return F.transform(parts, turn)


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives, and their text under the loss mask."""
    text = F.array_join(
        F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    masked = F.array_join(
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["piece"])), ""
    )
    return formatted.select(
        "tree",
        F.size(read_back(F.col("formatted"))).cast("bigint").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        let(masked, lambda m: F.struct(F.length(m).cast("bigint").alias("n"), F.sha2(m, 256).alias("h"))).alias("loss"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    ).select("tree", "n_turns", "turns_sha256", F.col("loss.n").alias("loss_chars"), F.col("loss.h").alias("loss_sha256"), "formatted_chars")


def linear_messages(rows: DataFrame) -> DataFrame:
    """Messages of conversations kept as rows by turn: each answers the one before it."""
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("bigint")
    return rows.select(F.col("conv_id").alias("tree"), node.alias("node"), "role", "text").select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )
