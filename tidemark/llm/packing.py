"""Optimal length buckets: the boundaries of least padding, and token-budget batches in each.

The lengths of all documents are counted, each by itself up to 8192 and in cells 1/128 of
the length wide above, so that the global histogram has about ten thousand rows at most for
any corpus. The edge of a cell is the greatest length that occurs in it. Dynamic programming over it finds the boundaries of ``buckets`` buckets for
which documents, padded to their bucket's boundary, are padded least, among boundaries at edges. Each bucket is then
cut into batches of as many documents as the token budget holds at that length.

To number the documents of a bucket without gathering them, they are dealt into shards of
bounded expected size; a shard numbers its own, and running totals per shard, one row
each, place the shards one after another. Only the last batch of a bucket is not full.

Defined results: lengths are words; a null or empty text has none, and null bucket, padded
length and batch; a document longer than the budget is a batch of its own; repeated rows
are packed each; a null doc_id is packed like any; an empty table gives an empty
result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored, words_of

FINE = 8192
BUCKETS = 16
TOKEN_BUDGET = 65_536
SHARD_ROWS = 50_000


def cell(length: Column) -> Column:
    """The greatest length that the cell of a length may hold; exact in whole numbers."""
    # 128 cells for each doubling: the step is the leading power of two, divided by 128.
    step = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(F.length(F.bin(length - 1)) - 8, F.lit(3)))
    width = F.when(length <= FINE, F.lit(1).cast("bigint")).otherwise(step)
    return F.ceil(length / width).cast("bigint") * width


def boundaries(edges: list[int], counts: list[int], buckets: int) -> list[int]:
    """The bucket boundaries, ascending, for which the sum of padded lengths is least.

    ``edges`` are the cells' greatest lengths, ascending, ``counts`` their documents.
    """
    if not edges:
        return []
    edge = np.asarray(edges, dtype=np.float64)
    below = np.concatenate([[0.0], np.cumsum(np.asarray(counts, dtype=np.float64))])
    cost = edge * below[1:]
    choices = []
    for _ in range(min(buckets, len(edges)) - 1):
        # One bucket more: cells up to k as before, the rest up to j padded to edge j.
        new, choice = np.empty_like(cost), np.zeros(len(edge), dtype=np.int64)
        for j in range(len(edge)):
            options = np.concatenate([[0.0], cost[:j]]) + edge[j] * (below[j + 1] - below[: j + 1])
            choice[j] = int(np.argmin(options))
            new[j] = options[choice[j]]
        cost = new
        choices.append(choice)
    ends, j = [len(edge) - 1], len(edge) - 1
    for choice in reversed(choices):
        j = int(choice[j]) - 1
        if j < 0:
            break
        ends.append(j)
    return [int(edges[k]) for k in reversed(ends)]


def packed(
    docs: DataFrame, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """doc_id, n_tokens, bucket, padded_len, batch and place in the batch of every document.

    Buckets are numbered by length, batches within their bucket.
    """
    lengths = stored(
        docs.select("doc_id", F.size(words_of(F.col("text"))).cast("bigint").alias("n_tokens"), F.xxhash64("doc_id", "text").alias("deal")),
        "lengths",
    )
    worded = lengths.filter("n_tokens > 0")
    cells = worded.groupBy(cell(F.col("n_tokens")).alias("cell"))
    histogram = cells.agg(F.max("n_tokens").alias("edge"), F.count("*").alias("count")).orderBy("edge").collect()
    ends = boundaries([r["edge"] for r in histogram], [r["count"] for r in histogram], buckets)
    shards = 1 + sum(r["count"] for r in histogram) // shard_rows

    ends_col = F.array(*(F.lit(e).cast("bigint") for e in ends)).cast("array<bigint>")
    bucket = F.size(F.filter(ends_col, lambda e: e < F.col("n_tokens")))
    dealt = worded.select("doc_id", "n_tokens", "deal", bucket.alias("bucket"), F.pmod("deal", F.lit(shards)).alias("shard"))
    sizes = dealt.groupBy("bucket", "shard").agg(F.count("*").alias("here"))
    before = F.sum("here").over(Window.partitionBy("bucket").orderBy("shard")) - F.col("here")
    offsets = sizes.select("bucket", "shard", before.alias("before"))
    in_shard = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("deal", "doc_id"))
    padded = F.get(ends_col, F.col("bucket"))
    fits = F.greatest(F.floor(F.lit(token_budget) / padded), F.lit(1)).cast("bigint")
    place = F.col("before") + F.col("in_shard") - 1
    numbered = dealt.withColumn("in_shard", in_shard).join(offsets, ["bucket", "shard"])
    placed = numbered.select(
        "doc_id",
        "n_tokens",
        F.col("bucket").cast("bigint").alias("bucket"),
        padded.alias("padded_len"),
        F.floor(place / fits).cast("bigint").alias("batch"),
        (place % fits).cast("bigint").alias("place"),
    )
    empty = lengths.filter("n_tokens = 0").select(
        "doc_id", "n_tokens", *(F.lit(None).cast("bigint").alias(c) for c in ("bucket", "padded_len", "batch", "place"))
    )
    return placed.unionByName(empty)
