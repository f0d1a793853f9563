"""A quality classifier by co-training a text view and a page-metadata view.

Each document has two views that share no feature: its text (the different words,
hashed, and its shape: how many of its characters and words are symbols, capitals or
repeated), and the metadata of its page (language, source, size, lines, words per line). A
naive Bayes model per view holds how often documents of either class have each feature. It
is counted first on the labelled documents. Then, for some rounds, each model scores *all*
unlabelled documents, those it is surest of, of either class in the proportion of the
labels, are labelled by it, and the other model is counted anew with them. Each model's
evidence, and both in the end, are calibrated into log odds by logistic regression on
labelled documents kept out of the counts. The same is done at once for a second label, toxicity.

How it runs: the views of each document are written once, as numbers. Each round is two
passes over them: one for the histogram of the evidence, which gives the cuts of the surest,
and one for the counts per feature. Counts are added up in tasks and summed by Spark, so a
model costs at most ``2**18`` rows a task, whatever the corpus; only features that tell the
classes apart (likelihood-ratio statistic over ``EVIDENCE``) come to the driver. Sums are
exact, so the result does not depend on the partitions. No labelled or unlabelled row is
left out; only the calibration, of a few numbers, reads at most ``CALIBRATE`` labelled rows,
chosen by a hash of their id.

Defined results: a null or empty text has no words, and is scored by its metadata; a text of
any length is read whole, its words taken once each; nulls of lang, source are a value of
their own; a null label is none; labels repeated for one id are taken once, the lowest;
repeated documents are counted and scored each; documents whose evidence ties at a cut are
all labelled; a null doc_id has no label; without labels of both classes all scores are 0.5
and all documents kept; an empty table gives an empty result; columns other than doc_id,
text, lang and source are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tidemark.llm.common import stored
from tidemark.llm.shingles import words

#: Families of features, with the bits of their hashes, and the views made of them.
BITS = {"word": 18, "shape": 10, "meta": 10}
VIEWS = {"text": ("word", "shape"), "meta": ("meta",)}
LABELS = ("quality", "toxic")
#: Rounds of exchange, and the share of the unlabelled documents that is labelled more in each.
ROUNDS, PER_ROUND = 2, 0.1
#: Weight of a pseudo-label, and the least change of the log odds that makes one.
PSEUDO, SURE = 0.5, 1.0
#: Features count from this likelihood-ratio statistic on.
EVIDENCE = 16.0
CALIBRATE = 6000
KEEP_FROM, TOXIC_FROM = 0.5, 0.5
#: Cells of the histogram per unit of log odds, which are cut at +-LIMIT for it.
CELLS, LIMIT = 16, 64

#: Per label and family the weights of the features.
Weights = dict[str, dict[str, np.ndarray]]
#: Per label and view the greatest and least log odds that make a pseudo-label of class 0 and 1.
Cuts = dict[str, dict[str, tuple[float, float]]]


@dataclass
class Models:
    """Weights of the features, scaled so that a view's sum and offset are log odds beyond the prior's."""

    weights: Weights
    offset: dict[str, dict[str, float]]
    prior: dict[str, float]


def _hashed(features: set[bytes], bits: int) -> bytes:
    return np.unique(np.array([xxh3_64_intdigest(f) >> (64 - bits) for f in features], dtype=np.int32)).tobytes()


_STEPS = (0, 0.002, 0.01, 0.03, 0.1, 0.2, 0.4)


def word_view(found: list[bytes]) -> bytes:
    """The different words, without case and punctuation."""
    return _hashed({w.strip(b".,;:!?") for w in set(found)} - {b""}, BITS["word"])


def shape_view(text: bytes, found: list[bytes]) -> bytes:
    """Shares of a text's characters, and of words that repeat the one before, in steps."""
    size = max(len(text), 1)
    codes = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    shares = {
        "symbol": codes[list(b"#*$%&|<>")].sum() / size,
        "bang": codes[ord("!")] / size,
        "upper": codes[65:91].sum() / size,
        "digit": codes[48:58].sum() / size,
        "again": sum(a == b for a, b in zip(found, found[1:], strict=False)) / max(len(found), 1),
    }
    return _hashed({f"{name}={sum(share > step for step in _STEPS)}".encode() for name, share in shares.items()}, BITS["shape"])


def meta_view(text: bytes, n_words: int, lang: str | None, source: str | None) -> bytes:
    """Where a page is from, and its layout: size, lines and words per line; no characters of the text."""
    lines = text.count(b"\n") + 1
    named = {f"lang={lang}", f"source={source}", f"size={int(np.log2(len(text) + 1))}", f"lines={int(np.log2(lines))}"}
    named.add(f"width={int(np.log2(n_words / lines + 1))}")
    return _hashed({name.encode() for name in named}, BITS["meta"])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: dict[str, list[bytes]] = {family: [] for family in BITS}
        for text, lang, source in zip(batch.column("text"), batch.column("lang"), batch.column("source"), strict=True):
            raw = text.as_py() or b""
            found = words(raw)
            columns["word"].append(word_view(found))
            columns["shape"].append(shape_view(raw, found))
            columns["meta"].append(meta_view(raw, len(found), lang.as_py(), source.as_py()))
        packed = {family: pa.array(values, pa.binary()) for family, values in columns.items()}
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **packed})


def views(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the views' features as packed numbers, the labels (-1: none) and whether a row calibrates; stored."""
    inputs = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    seen = inputs.mapInArrow(_featured, f"doc_id {id_type}, word binary, shape binary, meta binary")
    once = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.min(c).cast("int").alias(c) for c in LABELS))
    # Labels grow with the documents, so the join is shuffled at every size.
    joined = seen.join(once.hint("merge"), "doc_id", "left").select(
        "doc_id",
        *BITS,
        *(F.coalesce(c, F.lit(-1)).alias(c) for c in LABELS),
        F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0, F.lit(False)).alias("held"),
    )
    return stored(joined, "views")


def _places(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and features of a packed view, flat."""
    sizes = np.array([len(v) // 4 for v in (x.as_buffer() for x in column)], dtype=np.int64) if len(column) else np.zeros(0, np.int64)
    flat = np.frombuffer(b"".join(x.as_buffer() for x in column), dtype=np.int32)
    return np.repeat(np.arange(len(column)), sizes), flat


def _sums(places: tuple[np.ndarray, np.ndarray], weights: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(places[0], weights=weights[places[1]], minlength=n).astype(float)


def _odds(batch: pa.RecordBatch, models: Models) -> tuple[dict[str, tuple], dict[str, dict[str, np.ndarray]]]:
    """Row numbers and features per family, and the log odds beyond the prior's per label and view."""
    places = {family: _places(batch.column(family)) for family in BITS}
    odds = {
        c: {
            v: models.offset[c][v] + sum(_sums(places[f], models.weights[c][f], batch.num_rows) for f in families)
            for v, families in VIEWS.items()
        }
        for c in LABELS
    }
    return places, odds


def _cells(models: Models) -> Callable:
    """How many unlabelled documents have which log odds, per label and view."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {(c, v): np.zeros(2 * LIMIT * CELLS + 1, dtype=np.int64) for c in LABELS for v in VIEWS}
        for batch in batches:
            _, odds = _odds(batch, models)
            for c, v in counts:
                free = batch.column(c).to_numpy() < 0
                cell = np.floor(np.clip(odds[c][v][free], -LIMIT, LIMIT) * CELLS).astype(np.int64) + LIMIT * CELLS
                counts[c, v] += np.bincount(cell, minlength=len(counts[c, v]))
        for (c, v), found in counts.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_pydict({"label": pa.array([c] * len(at), pa.string()), "view": pa.array([v] * len(at), pa.string()), "cell": pa.array(at - LIMIT * CELLS, pa.int32()), "n": found[at]})

    return of_batches


def cuts_of(cells: dict[int, int], share: float, fraction: float) -> tuple[float, float]:
    """Log odds below which, and from which on, the surest ``fraction`` of the documents lie, by class."""
    total = sum(cells.values())
    low, high = -SURE, SURE
    for wanted, order, upper in ((fraction * (1 - share) * total, sorted(cells), False), (fraction * share * total, sorted(cells, reverse=True), True)):
        reached = 0
        for cell in order:
            reached += cells[cell]
            if reached >= wanted:
                break
        else:
            continue
        if upper:
            high = max(SURE, cell / CELLS)
        else:
            low = min(-SURE, (cell + 1) / CELLS)
    return low, high


def _counts(models: Models, cuts: Cuts) -> Callable:
    """How often documents of either class have each feature: the labelled, and those of which the other view is sure.

    The row with feature -1 has the documents, of the family of words all words.
    """

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {(c, f, y): np.zeros((1 << BITS[f]) + 1) for c in LABELS for f in BITS for y in (0, 1)}
        for batch in batches:
            places, odds = _odds(batch, models)
            held = batch.column("held").to_numpy(zero_copy_only=False)
            for c in LABELS:
                given = batch.column(c).to_numpy()
                for view, other in (("text", "meta"), ("meta", "text")):
                    sure = np.full(len(given), -1)
                    if cuts:
                        low, high = cuts[c][other]
                        sure = np.where(odds[c][other] >= high, 1, np.where(odds[c][other] < low, 0, -1))
                    for y in (0, 1):
                        weight = np.where((given == y) & ~held, 1.0, np.where((given < 0) & (sure == y), PSEUDO, 0.0))
                        for f in VIEWS[view]:
                            rows, features = places[f]
                            own = np.bincount(features, weights=weight[rows], minlength=1 << BITS[f])
                            sums[c, f, y][:-1] += own
                            sums[c, f, y][-1] += own.sum() if f == "word" else weight.sum()
        for c in LABELS:
            for f in BITS:
                bad, good = sums[c, f, 0], sums[c, f, 1]
                at = np.flatnonzero(bad + good)
                feature = np.where(at == len(bad) - 1, -1, at).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"label": pa.array([c] * len(at), pa.string()), "family": pa.array([f] * len(at), pa.string()), "feature": feature, "n0": bad[at], "n1": good[at]})

    return of_batches


def _weighed(seen: DataFrame, models: Models, cuts: Cuts) -> Weights:
    """The weights of the telling features, from counts over all rows."""
    parts = seen.select(*BITS, *LABELS, "held").mapInArrow(_counts(models, cuts), "label string, family string, feature int, n0 double, n1 double")
    sums = stored(parts.groupBy("label", "family", "feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "feature-counts")
    # One row per label and family.
    totals = F.broadcast(sums.filter("feature = -1 AND n0 > 0 AND n1 > 0").select("label", "family", F.col("n0").alias("all0"), F.col("n1").alias("all1")))
    pooled = (F.col("n0") + F.col("n1")) / (F.col("all0") + F.col("all1"))

    def told(n: str, total: str) -> Column:
        return F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / (F.col(total) * pooled))).otherwise(0.0)

    def share(n: str, total: str) -> Column:
        """Smoothed by half a document, or word, at the pooled share."""
        return (F.col(n) + 0.5) / (F.col(total) + 0.5 / pooled)

    # At most 2**bits rows per label and family.
    telling = (
        sums.filter("feature >= 0")
        .join(totals, ["label", "family"])
        .filter(2 * (told("n0", "all0") + told("n1", "all1")) > EVIDENCE)
        .select("label", "family", "feature", F.log(share("n1", "all1") / share("n0", "all0")).alias("w"))
        .collect()
    )
    weights: Weights = {c: {f: np.zeros(1 << BITS[f]) for f in BITS} for c in LABELS}
    for r in telling:
        weights[r["label"]][r["family"]][r["feature"]] = r["w"]
    return weights


def platt(x: np.ndarray, y: np.ndarray, steps: int = 40) -> np.ndarray:
    """Weights of the columns of ``x``, and an offset, of the likeliest probabilities, by Newton's method; zeros without both classes."""
    if len(set(y.tolist())) < 2:
        return np.zeros(x.shape[1] + 1)
    scale = x.std(axis=0) + 1e-9
    x1 = np.column_stack([x / scale, np.ones(len(y))])
    ridge = np.diag([1.0] * x.shape[1] + [1e-6])
    w = np.zeros(x1.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        hessian = (x1 * (p * (1 - p))[:, None]).T @ x1 + ridge
        step = np.linalg.solve(hessian, x1.T @ (y - p) - ridge @ w)
        w += step / max(1.0, np.abs(step).max() / 2)
    return np.append(w[:-1] / scale, w[-1])


def _calibrated(weights: Weights, sample: pa.RecordBatch) -> Models:
    """The models whose families are weighed, within each view, on the rows that calibrate."""
    models = Models({c: dict(weights[c]) for c in LABELS}, {c: dict.fromkeys(VIEWS, 0.0) for c in LABELS}, dict.fromkeys(LABELS, 0.0))
    places = {f: _places(sample.column(f)) for f in BITS}
    for c in LABELS:
        y = sample.column(c).to_numpy()
        own = y >= 0
        if len(set(y[own].tolist())) == 2:
            models.prior[c] = float(np.log(y[own].mean() / (1 - y[own].mean())))
        for v, families in VIEWS.items():
            x = np.column_stack([_sums(places[f], weights[c][f], len(y)) for f in families])
            w = platt(x[own], y[own].astype(float))
            models.weights[c].update({f: weights[c][f] * k for f, k in zip(families, w, strict=False)})
            models.offset[c][v] = float(w[-1]) - models.prior[c]
    return models


def _sample(seen: DataFrame) -> pa.RecordBatch:
    """At most ``CALIBRATE`` labelled rows, kept out of the counts."""
    rows = seen.filter("held AND (quality >= 0 OR toxic >= 0)").orderBy(F.xxhash64("doc_id"), "doc_id", *BITS).select(*BITS, *LABELS).limit(CALIBRATE).collect()
    columns = {f: pa.array([bytes(r[f]) for r in rows], pa.binary()) for f in BITS}
    return pa.RecordBatch.from_pydict(columns | {c: pa.array([r[c] for r in rows], pa.int32()) for c in LABELS})


def co_trained(seen: DataFrame, rounds: int = ROUNDS) -> tuple[Models, dict[str, np.ndarray]]:
    """The models after ``rounds`` of exchange, and per label the weights of both views and an offset."""
    sample = _sample(seen)
    none = Models({c: {f: np.zeros(1 << BITS[f]) for f in BITS} for c in LABELS}, {c: dict.fromkeys(VIEWS, 0.0) for c in LABELS}, {})
    models = _calibrated(_weighed(seen, none, {}), sample)
    for step in range(1, rounds + 1):
        cells = seen.select(*BITS, *LABELS).mapInArrow(_cells(models), "label string, view string, cell int, n bigint")
        found: dict[tuple[str, str], dict[int, int]] = {(c, v): {} for c in LABELS for v in VIEWS}
        for r in cells.groupBy("label", "view", "cell").agg(F.sum("n").alias("n")).collect():
            found[r["label"], r["view"]][r["cell"]] = r["n"]
        share = {c: 1 / (1 + np.exp(-models.prior[c])) for c in LABELS}
        cuts = {c: {v: cuts_of(found[c, v], share[c], min(1.0, PER_ROUND * step)) for v in VIEWS} for c in LABELS}
        models = _calibrated(_weighed(seen, models, cuts), sample)
    _, odds = _odds(sample, models)
    joint = {}
    for c in LABELS:
        y = sample.column(c).to_numpy()
        joint[c] = platt(np.column_stack([odds[c][v] for v in VIEWS])[y >= 0], y[y >= 0].astype(float))
    return models, joint


def _scored(models: Models, joint: dict[str, np.ndarray]) -> Callable:
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, odds = _odds(batch, models)
            p = {
                c: 1 / (1 + np.exp(-np.clip(np.column_stack([*odds[c].values(), np.ones(batch.num_rows)]) @ joint[c], -30, 30)))
                for c in LABELS
            }
            kept = (p["quality"] >= KEEP_FROM) & ((p["toxic"] < TOXIC_FROM) | ~joint["toxic"].any())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": p["quality"], "toxic_score": p["toxic"], "kept": kept})

    return of_batches


def classified(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, score (probability of good quality), toxic_score and kept of every document."""
    seen = views(docs, labels)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    scored = _scored(*co_trained(seen, rounds))
    return seen.select("doc_id", *BITS).mapInArrow(scored, f"doc_id {id_type}, score double, toxic_score double, kept boolean")
