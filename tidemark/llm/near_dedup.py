"""Near-duplicate documents by a chosen-path set-similarity join, in groups.

A document is its set of distinct word shingles. Documents with equal sets form a class,
which goes on as one document, its smallest id. Each class gets ``POSITIONS`` minwise
tokens and a sketch of one bit for each of ``SKETCH`` minwise hashes, made once.

The join walks ``TREES`` independent trees. In a tree a node holds the documents that
agree in the minwise tokens along its path. The first branching of each tree selects two
positions; of a document pair at the threshold, 0.8, a tree keeps 0.64 together, and all
trees miss 0.36 ** TREES. A small node is compared exhaustively, by sketches. A large node
is compared with a few of its documents only, others in every node, and of all its nodes a
document goes with the nearest one; the links found are confirmed on the full sets and merged. Where a large node then holds few documents outside its largest component,
these are compared with all of the node; a node of ``BLOCK`` documents at most is compared
exhaustively on the full sets, within a task; any other branches on into ``CHILDREN`` nodes by
``STEP`` further tokens each, of which a pair at the threshold shares more than one on average. So a group
of near copies, however large, costs a link per document and not all its pairs. Nodes
that are still large and divided at the last level are compared exhaustively.

All candidate links are confirmed on full sets. Sketches leave out a pair at the threshold
with a chance of about 1e-8.

Defined results: a null or empty text has the empty set and is linked with nothing; rows
that share a doc_id count as one document with several texts; rows without doc_id are kept and
linked with nothing (their component is null); an empty table gives an empty result.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.components import components
from tidemark.llm.shingles import shingle_set

SHINGLE = 5
PERCENT = 80
TREES = 16
POSITIONS, SKETCH = 128, 128
#: Bits of a sketch that agree in a pair at the threshold but for a chance of about 1e-8.
AGREE = 93
SMALL = 8
#: Rows up to which a divided node is compared exhaustively on the full sets, in one task.
BLOCK = 384
#: Documents of a large node that all others of it are compared with.
CENTRES = 3
LEVELS = 9
#: Later branchings: children of a node, and selected tokens that lead to each. A pair at the
#: threshold shares CHILDREN * 0.8 ** STEP = 1.23 children on average; below 1 links at the
#: threshold would fade with depth. The more positions, the less a pair's share of equal
#: tokens strays from its similarity.
CHILDREN, STEP = 3, 4
_CHUNK = 1024

_SIGNATURE = "doc_id bigint, n int, h1 bigint, h2 bigint, mins array<int>, s1 bigint, s2 bigint"


def _minwise(found: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), _CHUNK):
        values = np.multiply.outer(factors, found[at : at + _CHUNK])
        values += offsets[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least


def _signatures(size: int):
    rng = np.random.default_rng(20)
    factors = rng.integers(0, 2**63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offsets = rng.integers(0, 2**63, SKETCH, dtype=np.uint64)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n", "h1", "h2", "mins", "s1", "s2")}
            for text in batch.column(1):
                found = shingle_set(text.as_py(), size)
                least = _minwise(found, factors, offsets)
                bits = np.packbits(((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)).astype(np.uint8))
                halves = bits.view(np.int64)
                total = np.add.reduce(found).view(np.int64), np.bitwise_xor.reduce(found).view(np.int64)
                row = (len(found), int(total[0]), int(total[1]), (least[:POSITIONS] >> np.uint64(32)).astype(np.uint32).view(np.int32), int(halves[0]), int(halves[1]))
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
            kinds = {"n": pa.int32(), "mins": pa.list_(pa.int32())}
            arrays = [pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *out])

    return of_batches


def _sets(size: int):
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), size).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "found"])

    return of_batches


def _confirm(percent: int):
    """The links (a, b) among rows (a, b, set of a, set of b)."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similar = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_py(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                similar.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)], names=["a", "b"]
            ).filter(pa.array(similar, pa.bool_()))

    return of_batches


#: What a row of a node carries beside its key.
ROW = ["id", "n", "s1", "s2", "component"]


def _apart(x: str, y: str) -> Column:
    """Bits in which the sketches of two rows differ; ``x`` and ``y`` are prefixes."""
    return F.bit_count(F.col(f"{x}s1").bitwiseXOR(F.col(f"{y}s1"))) + F.bit_count(
        F.col(f"{x}s2").bitwiseXOR(F.col(f"{y}s2"))
    )


def _near(x: str, y: str, percent: int) -> Column:
    """Whether two rows' sizes and sketches allow a link."""
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (_apart(x, y) <= SKETCH - AGREE)


def _pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of rows of one node and different components that may be links."""
    a = members.select("key", *(F.col(c).alias(f"a_{c}") for c in ROW))
    b = members.select("key", *(F.col(c).alias(f"b_{c}") for c in ROW))
    other = (F.col("a_id") < F.col("b_id")) & (F.col("a_component") != F.col("b_component"))
    return a.join(b, "key").filter(other & _near("a_", "b_", percent)).select(
        F.col("a_id").alias("a"), F.col("b_id").alias("b")
    )


def _with_centres(large: DataFrame, percent: int) -> DataFrame:
    """For each row the nearest, by sketch, of the centres of its nodes that is of another component.

    A node's centres are chosen by hashes of node and id. One pair (a, b), a < b, per row.
    """
    row = [F.col(c) for c in ROW]
    chosen = large.groupBy("key").agg(
        *(F.min(F.struct(F.xxhash64(F.lit(k), "key", "id").alias("h"), *row)).alias(f"c{k}") for k in range(CENTRES))
    )
    centres = chosen.select("key", F.explode(F.array_distinct(F.array(*(F.col(f"c{k}") for k in range(CENTRES))))).alias("c"))
    centres = centres.select("key", *(F.col(f"c.{c}").alias(f"c_{c}") for c in ROW))
    star = large.join(centres, "key").filter((F.col("component") != F.col("c_component")) & _near("", "c_", percent))
    nearest = star.groupBy("id").agg(F.min(F.struct(_apart("", "c_").alias("apart"), "c_id")).alias("c"))
    return nearest.select(F.least("id", "c.c_id").alias("a"), F.greatest("id", "c.c_id").alias("b"))


def _block_links(size_of_chunk: int, percent: int):
    """The links of one node's rows (id, component, found) that join components, as a forest."""

    def of_node(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        sets = [np.frombuffer(v, dtype=np.uint64) for v in rows["found"]]
        sizes = np.array([len(x) for x in sets], dtype=np.int64)
        known, place = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        both = np.zeros((len(sets), len(sets)), dtype=np.float32)
        for at in range(0, len(known), size_of_chunk):
            here = (place >= at) & (place < at + size_of_chunk)
            has = np.zeros((len(sets), size_of_chunk), dtype=np.float32)
            has[owner[here], place[here] - at] = 1
            both += has @ has.T
        similar = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
        ids, root = rows["id"].to_numpy(), {c: c for c in rows["component"]}

        def top(c: int) -> int:
            while root[c] != c:
                c = root[c]
            return c

        parts, out = rows["component"].to_numpy(), []
        for i, j in zip(*np.nonzero(np.triu(similar, 1)), strict=True):
            x, y = top(parts[i]), top(parts[j])
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((ids[i], ids[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return of_node


def _crossed(some: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of a row of ``some`` and one of another component in its node."""
    x = some.select("key", *(F.col(c).alias(f"x_{c}") for c in ROW))
    y = members.select("key", *(F.col(c).alias(f"y_{c}") for c in ROW))
    return x.join(y, "key").filter((F.col("x_component") != F.col("y_component")) & _near("x_", "y_", percent)).select(
        F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")
    )


def _sets_of(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(id, found): the full sets of the documents named in ``ids`` (doc_id)."""
    ids = stored(ids.distinct(), "candidates")
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(ids, "doc_id", "left_semi")
    return stored(texts.mapInArrow(_sets(size), "id bigint, found binary"), "sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar; only the texts that they name are read."""
    sets = _sets_of(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), docs, size)
    joined = (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("found").alias("of_a")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("found").alias("of_b")), "b")
        .select("a", "b", "of_a", "of_b")
    )
    return joined.mapInArrow(_confirm(percent), "a bigint, b bigint")


def _paths() -> Column:
    """The node keys of a document after the first branching of every tree."""
    order = random.Random(7).sample(range(POSITIONS), 2 * TREES)
    return F.array(
        *(
            F.xxhash64(F.lit(tree), F.col("mins")[order[2 * tree]], F.col("mins")[order[2 * tree + 1]])
            for tree in range(TREES)
        )
    )


def _branched(key: Column, mins: Column) -> Column:
    """Keys of the nodes below; which positions a node selects depends on its key alone.

    A child's path is longer by ``STEP`` selected tokens.
    """

    def child(k: int) -> Column:
        places = [F.pmod(F.xxhash64(key, F.lit(k), F.lit(i)), F.lit(POSITIONS)).cast("int") for i in range(STEP)]
        return F.xxhash64(key, F.lit(k), *(F.get(mins, p) for p in places))

    return F.array(*(child(k) for k in range(CHILDREN)))


def groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    signed = stored(texts.mapInArrow(_signatures(shingle), _SIGNATURE), "signatures")
    classes = signed.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"))
    members = signed.select("doc_id", "n", "h1", "h2").join(classes, ["n", "h1", "h2"], "left")
    members = stored(members.select("doc_id", "n", F.expr("nvl2(doc_id, coalesce(rep, doc_id), null)").alias("rep")), "members")

    one = members.select("rep").distinct()
    kinds = signed.filter("n > 0").join(one, F.col("doc_id") == F.col("rep"), "left_semi")
    kinds = kinds.select(F.col("doc_id").alias("id"), "n", "mins", "s1", "s2")
    frontier = kinds.select("id", "n", "s1", "s2", F.col("id").alias("component"), F.explode(_paths()).alias("key"))
    labels = _joined(kinds, frontier, docs, shingle, percent)

    # Rows of one id with several texts are several classes of one document.
    return members.join(labels.withColumnsRenamed({"id": "rep", "component": "label"}), "rep", "left").select(
        "doc_id",
        F.col("n").cast("bigint").alias("n_shingles"),
        F.coalesce("label", "rep").alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == F.coalesce("label", "rep"))).alias("kept"),
    )


def _joined(kinds: DataFrame, frontier: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, component) of all linked classes: the walk down the trees, level by level."""
    links: DataFrame | None = None
    rest: DataFrame | None = None
    for level in range(LEVELS):
        last = level == LEVELS - 1
        nodes = frontier.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
        held = stored(frontier.join(nodes, "key"), "nodes")
        small = held if last else held.filter(F.col("members") <= SMALL)
        large = held.filter(F.col("members") > SMALL)
        found = _pairs(small, percent)
        if not last:
            found = found.union(_with_centres(large, percent))
        found = (found if rest is None else found.union(rest)).distinct()
        confirmed = _confirmed(stored(found, "pairs"), docs, size, percent)
        links = stored(confirmed if links is None else links.union(confirmed), "links")
        if last:
            break
        labels = components(links)
        labelled = large.drop("component").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        parts = labelled.groupBy("key", "component").agg(F.count("*").alias("c"))
        nodes = parts.groupBy("key").agg(
            F.max_by("component", "c").alias("most"), F.max("c").alias("c_most"), F.sum("c").alias("c_all")
        )
        divided = labelled.join(nodes.filter("c_most < c_all"), "key")
        divided = stored(divided.withColumn("few", F.expr(f"c_all - c_most <= {SMALL}")), "divided")
        # Few rows outside the largest component of a node: each is compared with all its rows.
        few = divided.filter("few")
        blocks = divided.filter(f"NOT few AND c_all <= {BLOCK}").select("key", "id", "component")
        linked = blocks.join(_sets_of(blocks.select(F.col("id").alias("doc_id")), docs, size), "id")
        linked = linked.groupBy("key").applyInPandas(_block_links(_CHUNK, percent), "a bigint, b bigint")
        links = stored(links.union(linked).distinct(), "links")
        rest = _crossed(few.filter("component <> most"), few, percent)
        frontier = (
            divided.filter(f"NOT few AND c_all > {BLOCK}")
            .join(kinds.select("id", "mins"), "id")
            .select(*ROW, F.explode(_branched(F.col("key"), F.col("mins"))).alias("key"))
        )
        frontier = stored(frontier.distinct(), "frontier")
        if frontier.isEmpty() and rest.isEmpty():
            break
    return components(links)


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents with one of each group, the one of the smallest id, all columns."""
    judged = groups(docs, shingle, percent)
    gone = stored(judged.filter("NOT kept").select("doc_id").distinct(), "duplicates")
    return docs.join(gone, "doc_id", "left_anti")
