"""Ranked lexical search of every document for every query text: the Best Position Algorithm.

A term has a list of the documents that hold it, highest impact first. Lists are read in
parallel from the top; each document met is looked up at once in all other lists of the query
(direct access), which gives its score and marks its places there as seen. A list's best
position is the last of its unbroken run of seen places, so lists move on by places that were
only seen in others, and the sum of the impacts at the best positions bounds every document
not met yet. Reading stops when that sum is strictly below the k-th best score, so documents
tied with the k-th are always met.

On Spark: each document becomes one row of query terms and counts; totals and document
frequencies are aggregates over those rows. A task reads its rows in blocks of a bounded number
of postings, builds the impact lists of a block, and searches them with the k best documents of
its earlier blocks as a start. The k best of every task are merged by a window, at first per
group of tasks. Queries are read in blocks of bounded bytes, each with its own run.

Null texts have no terms; a document without terms, a query without terms or without hits gives
no row. Rows alike in doc_id are documents of their own, as are rows alike in item_id queries of
their own. Ties go to the smaller doc_id, a null one first. Texts may have any length: a document
longer than a block is a block by itself. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.session import shared_dir

TOP = 20
#: Bytes of query texts that one run answers; they are sent to every task.
QUERY_BYTES = 1 << 22
#: Postings whose lists one block holds in memory.
BLOCK_POSTINGS = 1 << 20
#: Places first read from each list; each further reading goes twice as deep.
DEPTH = 32
#: Groups of tasks whose best rows are merged first.
GROUPS = 64
_SCALE = 1_000_000_000
_DELIMITERS = bytes(c if chr(c).isalnum() or c > 0x7F else 0x20 for c in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    """Runs of letters, digits and anything beyond ASCII, A-Z in lower case."""
    return text.translate(_DELIMITERS).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int, weights: np.ndarray) -> np.ndarray:
    m = 75 + (25 * length * n_docs) // n_terms
    return weights * ((_SCALE * tf) // (1000 * tf + 12 * m))


def query_blocks(queries: DataFrame, most: int = QUERY_BYTES) -> Iterator[list[tuple]]:
    """(item_id, terms) of the queries in blocks of bounded bytes, read one partition at a time."""
    block, size = [], 0
    for row in queries.select("item_id", "text").toLocalIterator():
        text = (row["text"] or "").encode()
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append((row["item_id"], Counter(terms(text))))
        size += len(text)
    if block:
        yield block


def _forward(vocabulary: dict[bytes, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, n, terms, counts) of each document with a term; ``terms`` are numbers of query terms."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, numbers, counts = [], [], [], []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                found = terms(text.as_buffer().to_pybytes()) if text.is_valid else []
                if found:
                    hits = Counter(map(vocabulary.__getitem__, filter(vocabulary.__contains__, found)))
                    ids.append(doc_id.as_py())
                    lengths.append(len(found))
                    numbers.append(list(hits.keys()))
                    counts.append(list(hits.values()))
            columns = [pa.array(ids, batch.column(0).type), pa.array(lengths, pa.int64()), pa.array(numbers, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "counts"])

    return of_batches


class Lists:
    """The impact lists of one block: by impact for reading, by document for direct access."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int) -> None:
        self.n_docs = n_docs
        # Documents are numbered in order of doc_id, so the smaller one comes first in a tie.
        by_doc = np.lexsort((doc, term))
        self.doc, self.impact = doc[by_doc], impact[by_doc]
        self.bounds = np.searchsorted(term[by_doc], np.arange(n_terms + 1))
        by_impact = np.lexsort((doc, -impact, term))
        self.ranked_doc, self.ranked_impact = doc[by_impact], impact[by_impact]
        # The place in its impact list of each posting in order of documents.
        place = np.empty(len(doc), np.int64)
        place[by_impact] = np.arange(len(doc)) - self.bounds[term[by_impact]]
        self.place = place[by_doc]

    def best(self, query: list[tuple[int, int]], k: int, kth: int) -> list[tuple[int, int]]:
        """(score, document) of the k best of the block that reach ``kth``, the k-th best score so far."""
        lists = [(slice(*self.bounds[t : t + 2]), times) for t, times in query if self.bounds[t] < self.bounds[t + 1]]
        lists = [(at, times) for at, times in lists if self.ranked_impact[at.start] > 0]
        if not lists:
            return []
        seen = [np.zeros(at.stop - at.start + 1, bool) for at, _ in lists]
        reach, depth, deeper = [0] * len(lists), 0, DEPTH
        known = np.zeros(self.n_docs, bool)
        met, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while True:
            read = np.zeros(self.n_docs, bool)
            for at, _ in lists:
                read[self.ranked_doc[at.start + depth : min(at.start + deeper, at.stop)]] = True
            new = np.flatnonzero(read & ~known)
            known |= read
            depth, deeper = deeper, 2 * deeper
            score = np.zeros(len(new), np.int64)
            for i, (at, times) in enumerate(lists):
                own = self.doc[at]
                found = np.searchsorted(own, new)
                found[found == len(own)] = 0
                there = own[found] == new
                score[there] += times * self.impact[at][found[there]]
                seen[i][self.place[at][found[there]]] = True
                reach[i] += int(np.argmin(seen[i][reach[i] :]))
            met, scores = np.concatenate([met, new]), np.concatenate([scores, score])
            # reach is the number of unbroken seen places; the last of them is the best position.
            bound = sum(times * int(self.ranked_impact[at.start + r - 1]) for (at, times), r in zip(lists, reach, strict=True) if r < at.stop - at.start)
            if len(scores) >= k:
                kth = max(kth, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
            if bound < max(kth, 1):
                break
        order = np.lexsort((met, -scores))[:k]
        return [(int(scores[o]), int(met[o])) for o in order if scores[o] >= max(kth, 1)]


def _searched(queries: list[list[tuple[int, int]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(query, doc_id, score): the k best documents of a task for each query."""

    def key(hit: tuple) -> tuple:
        return (-hit[0], hit[1] is not None, hit[1])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in queries]
        doc_type = None
        for batch in chain.from_iterable(map(_blocks, batches)):
            doc_type = batch.column(0).type
            ids = batch.column(0).to_pylist()
            order = sorted(range(len(ids)), key=lambda d: (ids[d] is not None, ids[d]))
            number = np.empty(len(ids), np.int64)
            number[order] = np.arange(len(ids))
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            term, tf = (batch.column(c).flatten().to_numpy() for c in (2, 3))
            length = np.repeat(batch.column(1).to_numpy(), sizes)
            lists = Lists(np.repeat(number, sizes), term, impacts(tf, length, n_docs, n_terms, weights[term]), len(ids), len(weights))
            for q, query in enumerate(queries):
                kth = best[q][-1][0] if len(best[q]) == k else 0
                if hits := lists.best(query, k, kth):
                    best[q] = sorted(best[q] + [(score, ids[order[d]]) for score, d in hits], key=key)[:k]
        if doc_type is not None:
            rows = [(q, doc_id, score) for q, hits in enumerate(best) for score, doc_id in hits]
            columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), doc_type, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["query", "doc_id", "score"])

    return of_batches


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most BLOCK_POSTINGS postings or one document."""
    ends = batch.column(2).offsets.to_numpy()
    low = 0
    while low < len(batch):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + BLOCK_POSTINGS, side="right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def _one_block(docs: DataFrame, block: list[tuple], item_type: str, k: int) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, found in block for t in found}))}
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(
        docs.select("doc_id", "text").mapInArrow(_forward(vocabulary), f"doc_id {doc_type}, n bigint, terms array<int>, counts array<bigint>"),
        "query-terms",
    )
    total = rows.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms")).first()
    # At most as many rows as the block of queries has terms.
    df = dict(rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    weights = np.array([weight(total["n_docs"], df.get(i, 0)) for i in range(len(vocabulary))], np.int64)
    queries = [[(vocabulary[t], times) for t, times in sorted(found.items())] for _, found in block]
    hits = rows.mapInArrow(
        _searched(queries, weights, total["n_docs"], max(total["n_terms"], 1), k), f"query bigint, doc_id {doc_type}, score bigint"
    ).withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    for group in (["query", "_group"], ["query"]):
        order = Window.partitionBy(*group).orderBy(F.col("score").desc(), "doc_id")
        hits = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    items = docs.sparkSession.createDataFrame([(q, item) for q, (item, _) in enumerate(block)], f"query bigint, item_id {item_type}")
    return hits.join(F.broadcast(items), "query").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each query."""
    session = docs.sparkSession
    item_type, doc_type = (t.schema[c].dataType.simpleString() for t, c in ((queries, "item_id"), (docs, "doc_id")))
    path, schema = shared_dir(session, "hits"), f"item_id {item_type}, rank int, doc_id {doc_type}, score bigint"
    session.createDataFrame([], schema).write.parquet(path)
    for block in query_blocks(queries):
        _one_block(docs, block, item_type, k).write.mode("append").parquet(path)
    return session.read.schema(schema).parquet(path)
