"""Language-model scores of whole documents by a gated recurrent model and corpus counts.

Every word of the training documents is counted on Spark, and the counts stay a table.
The model knows the ``MODEL_WORDS`` most frequent words, any other word and the end.
Every partition trains it on its documents from the common parameters, and the
parameters are averaged by tokens, as rows, in each of the rounds; together the rounds
read all training documents once. A word that the model does not know has the
probability of any other word, times its share of such words, smoothed by one.

Counts of the ``TASK_WORDS`` most frequent words go to the tasks that score; all other words of a
document go, as (word, document, times) rows, to a join with the count table. So both
lists in tasks are bounded, no word is a hot key, and no list of words is whole anywhere.

Defined results: a null or empty text is its end alone; a null doc_id counts as the empty text
in the choice of training documents; repeated rows are scored each, alike; without training
documents all counts are 0; an empty table gives an empty result; other columns than
doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import gru
from tidemark.llm.common import stored
from tidemark.llm.shingles import words

MODEL_WORDS = 2000
TASK_WORDS = 65_536
FOLDS, HELD_OUT = 7, 2
#: Share of the training documents, in sixteenths, that each round of training reads.
ROUNDS = (range(0, 2), range(2, 16))
_FLUSH = 200_000


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n); the end is the empty word."""

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"]
        )

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            counts.update(words(text.as_py()))
            counts[b""] += 1
            if len(counts) > _FLUSH:
                yield rows(counts)
                counts = Counter()
    yield rows(counts)


def word_counts(train: DataFrame) -> DataFrame:
    """(word, n) of all words of the documents, the empty word for their ends."""
    partial = train.select(F.col("text").cast("binary")).mapInArrow(_count, "word string, n bigint")
    return stored(partial.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def _tokens(text: bytes | None, ids: dict[bytes, int], other: int) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(ids.get, found, repeat(other)), dtype=np.int32, count=len(found))


def _train(params: gru.Params, ids: dict[bytes, int], end: int, other: int):
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = gru.Trainer(params)
        for batch in batches:
            docs = [_tokens(t.as_py(), ids, other) for t in batch.column(0)]
            if docs:
                trainer.learn(docs, end)
        if trainer.tokens:
            values = gru.flat(trainer.params).astype(np.float64) * trainer.tokens
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(values))), pa.array(values), pa.array(np.full(len(values), float(trainer.tokens)))],
                names=["k", "weighted", "weight"],
            )

    return of_batches


def trained(train: DataFrame, ids: dict[bytes, int], end: int, other: int) -> gru.Params:
    """The parameters after all rounds; what the driver reads is one row per parameter."""
    params = gru.initial(len(ids) + 2)
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(16))
    for part in ROUNDS:
        texts = train.filter(share.between(part.start, part.stop - 1)).select(F.col("text").cast("binary"))
        sums = texts.mapInArrow(_train(params, ids, end, other), "k bigint, weighted double, weight double")
        rows = sums.groupBy("k").agg((F.sum("weighted") / F.sum("weight")).alias("value")).orderBy("k").collect()
        if rows:
            params = gru.shaped(np.array([r["value"] for r in rows]), params)
    return params


def _score(params: gru.Params, n_model: int, end: int, other: int, counts: dict[bytes, int]):
    """Rows of documents, keyed apart, and rows of the words whose counts the task does not know.

    The first ``n_model`` words of ``counts`` are those of the model.
    """
    schema = pa.schema([("row", pa.int64()), ("word", pa.string()), ("times", pa.int64()), ("n_tokens", pa.int64()),
                        ("n_known", pa.int64()), ("log_counts", pa.float64()), ("n_other", pa.int64()),
                        ("other_logs", pa.float64()), ("model", pa.float64())])
    ends = counts.get(b"", 0)
    place = {word: k for k, word in enumerate(w for w in counts if w)}
    logs = np.log10(np.fromiter((counts[w] for w in place), dtype=np.float64, count=len(place)) + 1)
    log_end = math.log10(ends + 1)

    def batch_of(**columns: list | np.ndarray | pa.Array) -> pa.RecordBatch:
        n = len(columns["row"])
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name] if f.name in columns else np.zeros(n), f.type) for f in schema], schema=schema
        )

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, docs, sums = batch.column(0).to_pylist(), [], []
            rare_rows, rare, times = [], [], []
            for row, text in zip(rows, batch.column(1), strict=True):
                found = words(text.as_py())
                at = np.fromiter(map(place.get, found, repeat(-1)), dtype=np.int32, count=len(found))
                docs.append(np.where((at >= 0) & (at < n_model), at, np.int32(other)))
                unknown = at < 0
                n_unknown = int(unknown.sum())
                of_others = float(logs[at[at >= n_model]].sum())
                of_model = float(logs[at[docs[-1] != other]].sum())
                n_other = int((docs[-1] == other).sum())
                sums.append((len(found) + 1, len(found) - n_unknown + bool(ends), of_model + of_others + log_end, n_other, of_others))
                if n_unknown:
                    counted = Counter(compress(found, unknown.tolist()))
                    rare_rows.extend(repeat(row, len(counted)))
                    rare.extend(counted.keys())
                    times.extend(counted.values())
            if rare:
                yield batch_of(row=rare_rows, word=pa.array(rare, pa.binary()).cast(pa.string()), times=times)
            if docs:
                n_tokens, n_known, log_counts, n_other, other_logs = zip(*sums, strict=True)
                # A document's own row is the one that counts its end.
                yield batch_of(
                    row=rows, word=[f" {row}" for row in rows], n_tokens=n_tokens, n_known=n_known, log_counts=log_counts,
                    n_other=n_other, other_logs=other_logs, model=gru.scores(params, docs, end),
                )

    return of_batches


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    train = docs.filter(fold(F.col("doc_id")) != HELD_OUT)
    counts = word_counts(train)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.filter("word <> ''").orderBy(F.desc("n"), "word").limit(TASK_WORDS).collect()
    ends = counts.filter("word = ''").collect()
    model_words = [(r["word"].encode(), r["n"]) for r in top[:MODEL_WORDS]]
    ids = {word: k for k, (word, _) in enumerate(model_words)}
    end, other = len(ids), len(ids) + 1
    params = trained(train, ids, end, other)

    known = {r["word"].encode(): r["n"] for r in top} | {b"": ends[0]["n"] if ends else 0}
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("binary").alias("text"))
    rows = numbered.select("row", "text").mapInArrow(
        _score(params, len(ids), end, other, known),
        "row bigint, word string, times bigint, n_tokens bigint, n_known bigint, log_counts double, n_other bigint, other_logs double, model double",
    )
    rare = counts.withColumnRenamed("n", "c")
    joined = rows.join(rare, "word", "left")
    log_c = F.when(F.col("times") > 0, F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1)).otherwise(0.0)
    sums = joined.groupBy("row").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c").isNotNull() & (F.col("times") > 0), F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("log_counts") + log_c).alias("log_counts"),
        F.sum("n_other").alias("n_other"),
        F.sum(F.col("other_logs") + log_c).alias("other_logs"),
        F.sum("model").alias("model"),
    )
    in_model = sum(n for _, n in model_words) + known[b""]
    n_other = math.log10(max(total["n"] - in_model, 0) + max(total["v"] - len(ids) - bool(ends), 0) + 1)
    n_all = math.log10(total["n"] + total["v"] + 1)
    return sums.join(numbered.select("row", "doc_id"), "row").select(
        "doc_id",
        (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(total["n"]).cast("bigint").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * n_all).alias("base_score"),
        (F.col("model") + F.col("other_logs") - F.col("n_other") * n_other).alias("score"),
    )
