"""Line dedup by an exact set-similarity join: a line goes if an earlier one is similar.

A line is its set of distinct words; two lines are similar from a Jaccard similarity of
0.8 on. Lines come in the order of doc_id, then place. Lines of equal sets form a class,
its first line stands for it. Words are ordered by rarity: the corpus counts of hash
buckets of words, then the hash. Any one order keeps the join exact; rarity only makes it
cheap. The buckets, a power of two from ``BUCKETS`` for few words to ``MOST_BUCKETS``,
bound what each task must know of it; the more of them, the fewer rare words pass for
frequent ones, and the fewer lines share a prefix word.

Two similar sets share a word among the first of either (the prefix filter). Postings
(word, class) of prefix words are joined under the length filter, the positional filter
and a parity filter: the bits in which two 128-bit parities of the hashed words differ
are no more than the words that only one set has. What passes is verified on full sets.

As removal needs one earlier match and not all of them, the postings of a word that has many
are first compared with its earliest line of like length, which removes groups of near copies at a
link per line; then what is left is compared with all lines, removed or not. Which classes are
removed is marked once per class, before postings are made, and postings carry no places: which
line of a pair is earlier is told when it is verified.

Defined results: a null or blank line has no words, is never removed and never matches;
null texts have no lines; rows alike in doc_id and text count as one row and fare alike;
a null doc_id comes first in the order; an empty table gives an empty result; columns of
the input other than doc_id and text pass through unread (n_chars, if there, is
computed anew where text was removed).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_broadcast, let, stored, words_of

PERCENT = 80
BUCKETS, MOST_BUCKETS = 8192, 1 << 18
#: Words of the corpus for each bucket beyond the first ``BUCKETS``, at least.
WORDS_PER_BUCKET = 64
_LEVELS = 127
#: Postings of a word above which they are first compared with the earliest line of like length.
HOT = 256


def _row_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))


def _lines(docs: DataFrame) -> DataFrame:
    """(row, doc_id, line_no, line) of every line with a word."""
    lines = docs.select(
        _row_key().alias("row"), "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
    return lines.filter(F.col("line").rlike(r"[^ \t-\r]"))


def rarity(docs: DataFrame, buckets: int = BUCKETS, most: int = MOST_BUCKETS) -> list[int]:
    """For each hash bucket of words a level from 0 (rare) to 127 (frequent), by all documents.

    There are ``buckets`` of them, or up to ``most`` if the documents have many words.
    """
    most = max(buckets, most)
    hashed = F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w).bitwiseAND(F.lit(most - 1)))
    found = docs.select(F.explode(hashed).alias("bucket")).groupBy("bucket").count().toArrow()
    counts = np.zeros(most, dtype=np.int64)
    counts[found["bucket"].to_numpy()] = found["count"].to_numpy()
    # A bucket of fewer takes the words of every so many of more.
    while most > buckets and most * WORDS_PER_BUCKET > counts.sum():
        most //= 2
        counts = counts[:most] + counts[most:]
    return [min(_LEVELS, int(3 * math.log2(n + 1))) for n in counts.tolist()]


def _ordered(line: Column, levels: list[int]) -> Column:
    """The line's distinct words as numbers, rarest first: level, then hash."""
    # Folded into one literal array by the optimizer.
    level_of = F.split(F.lit(",".join(map(str, levels))), ",").cast("array<bigint>")
    keys = F.transform(
        words_of(line),
        lambda w: let(
            F.xxhash64(w),
            lambda h: F.shiftleft(F.get(level_of, h.bitwiseAND(F.lit(len(levels) - 1)).cast("int")), 56).bitwiseOR(
                F.shiftrightunsigned(h, 8)
            ),
        ),
    )
    return F.sort_array(F.array_distinct(keys))


def _parity(keys: Column, half: int) -> Column:
    """One of two halves of 128 bits; every word flips one bit of either half."""

    def bit(key: Column) -> Column:
        here = F.shiftright(key, 6).bitwiseAND(F.lit(1)).bitwiseXOR(F.lit(half).cast("long"))
        return F.call_function("shiftleft", here, key.bitwiseAND(F.lit(63)).cast("int"))

    return F.aggregate(keys, F.lit(0).cast("long"), lambda bits, k: bits.bitwiseXOR(bit(k)))


def _low_half(key: Column) -> Column:
    """The lower 32 bits of a word's number, all of them from its hash."""
    return F.shiftright(F.shiftleft(key, 32), 32).cast("int")


def _classes(docs: DataFrame, levels: list[int], percent: int) -> tuple[DataFrame, DataFrame]:
    """All lines with the key of their class, and all classes with their first line and prefix."""

    def of_set(keys: Column) -> Column:
        n = F.size(keys)
        prefix = n - F.ceil(n * percent / F.lit(100.0) - 1e-9).cast("int") + 1
        return F.struct(
            n.alias("n"),
            F.xxhash64(keys).alias("k1"),
            F.xxhash64(F.lit(1), keys).alias("k2"),
            _parity(keys, 0).alias("p1"),
            _parity(keys, 1).alias("p2"),
            F.transform(F.slice(keys, F.lit(1), prefix), _low_half).alias("prefix"),
        )

    lines = stored(
        _lines(docs)
        .select("row", "doc_id", "line_no", let(_ordered(F.col("line"), levels), of_set).alias("s"))
        .select("row", "doc_id", "line_no", "s.*"),
        "lines",
    )
    place = F.struct("doc_id", "row", "line_no")
    first = lines.groupBy("k1", "k2").agg(F.min(F.struct(place.alias("place"), "n", "p1", "p2", "prefix")).alias("c"))
    return lines, stored(first.select("k1", "k2", "c.*"), "classes")


def _allowed(x: str, y: str, percent: int) -> Column:
    """Whether the length, positional and parity filters let a pair of postings pass."""
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    rest = F.least(n - F.col(f"{x}i"), m - F.col(f"{y}i"))
    apart = F.bit_count(F.col(f"{x}p1").bitwiseXOR(F.col(f"{y}p1"))) + F.bit_count(
        F.col(f"{x}p2").bitwiseXOR(F.col(f"{y}p2"))
    )
    return (
        (100 * F.least(n, m) >= percent * F.greatest(n, m))
        & ((100 + percent) * rest >= percent * (n + m))
        & ((100 + percent) * (n + m - apart) >= 2 * percent * (n + m))
    )


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, levels: list[int], percent: int) -> DataFrame:
    """(early, late): the pairs (a, b) of classes whose full sets are similar, by their first lines.

    Ties of place are broken by the key.
    """
    named = stored(pairs.select(F.col("a").alias("k1")).union(pairs.select("b")).distinct(), "named")
    places = classes.join(bounded_broadcast(named), "k1", "left_semi")
    places = stored(places.select("k1", "k2", "place.row", "place.doc_id", "place.line_no"), "places")
    rows = docs.join(places.select(F.col("row").alias("_row")).distinct(), _row_key() == F.col("_row"), "left_semi")
    sets = _lines(rows).drop("doc_id").join(places, ["row", "line_no"])
    place = F.struct("doc_id", "line_no", "k1").alias("place")
    sets = stored(sets.select("k1", place, _ordered(F.col("line"), levels).alias("keys")).dropDuplicates(["k1"]), "sets")
    both = F.size(F.array_intersect("of_a", "of_b"))
    a_first = F.col("place_a") < F.col("place_b")
    return (
        pairs.join(sets.select(F.col("k1").alias("a"), F.col("place").alias("place_a"), F.col("keys").alias("of_a")), "a")
        .join(sets.select(F.col("k1").alias("b"), F.col("place").alias("place_b"), F.col("keys").alias("of_b")), "b")
        .filter((100 + percent) * both >= percent * (F.size("of_a") + F.size("of_b")))
        .select(F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("early"), F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("late"))
    )


_POSTING = ["k1", "n", "p1", "p2", "i"]


def _postings(classes: DataFrame, *more: str) -> DataFrame:
    """A row for each prefix word of each class."""
    return classes.select("k1", "n", "p1", "p2", *more, F.posexplode("prefix").alias("i", "word"))


def _late_classes(docs: DataFrame, classes: DataFrame, levels: list[int], percent: int) -> DataFrame:
    """(late, early): every class with a similar class before it, with one such class."""
    counts = classes.select(F.explode("prefix").alias("word")).groupBy("word").count()
    hot = bounded_broadcast(stored(counts.filter(F.col("count") > HOT).select("word"), "hot-words"))
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int")
    crowded = _postings(classes, "place.doc_id", "place.line_no").join(hot, "word").withColumn("band", band)
    # One shuffle: the earliest line comes first in its group and is carried along.
    of_group = Window.partitionBy("word", "band").orderBy("doc_id", "line_no", "k1").rowsBetween(Window.unboundedPreceding, 0)
    earliest = F.first(F.struct(*_POSTING)).over(of_group)
    star = crowded.withColumn("f", earliest).select(*_POSTING, *(F.col(f"f.{c}").alias(f"f_{c}") for c in _POSTING))
    star = star.filter((F.col("k1") != F.col("f_k1")) & _allowed("", "f_", percent))
    star = stored(star.select(F.least("k1", "f_k1").alias("a"), F.greatest("k1", "f_k1").alias("b")).distinct(), "star")
    by_star = stored(
        _verified(star, docs, classes, levels, percent).groupBy("late").agg(F.min("early").alias("early")), "late"
    )

    # Which classes are gone is marked before their postings are made, and these are dealt out once:
    # filters that are not deterministic, of all classes that are not gone and of all, stay behind
    # the shuffle and let none pass, so both sides read the same one.
    gone = bounded_broadcast(by_star.select(F.col("late").alias("k1"), F.lit(True).alias("gone")))
    marked = classes.join(gone, "k1", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    dealt = _postings(marked, "gone").repartition("word")
    kept = "CASE WHEN gone THEN monotonically_increasing_id() {} 0 ELSE true END"
    left = dealt.filter(kept.format("<")).select("word", *(F.col(c).alias(f"l_{c}") for c in _POSTING))
    right = dealt.filter(kept.format(">=")).select("word", "gone", *(F.col(c).alias(f"r_{c}") for c in _POSTING))
    rest = left.join(right, "word").filter((F.col("gone") | (F.col("l_k1") < F.col("r_k1"))) & _allowed("l_", "r_", percent))
    rest = rest.select(F.least("l_k1", "r_k1").alias("a"), F.greatest("l_k1", "r_k1").alias("b")).distinct()
    rest = stored(rest.join(star, ["a", "b"], "left_anti"), "rest")
    by_rest = _verified(rest, docs, classes, levels, percent).groupBy("late").agg(F.min("early").alias("early"))
    by_rest = by_rest.join(by_star.select("late"), "late", "left_anti")
    return stored(by_star.unionByName(by_rest), "late")


def judged_lines(docs: DataFrame, percent: int = PERCENT, buckets: int = BUCKETS) -> DataFrame:
    """(row, doc_id, line_no, n_tokens, removed, match_doc_id, match_line) of every line with words.

    The match is an earlier similar line, null if there is none.
    """
    levels = rarity(docs, buckets)
    lines, classes = _classes(docs, levels, percent)
    late = _late_classes(docs, classes, levels, percent)
    first = classes.select("k1", "k2", F.col("place").alias("first"))
    matched = late.join(first.select(F.col("k1").alias("early"), F.col("first").alias("match")), "early").select(
        F.col("late").alias("k1"), "match"
    )
    of_class = first.join(matched.dropDuplicates(["k1"]), "k1", "left")
    own_first = (F.col("first.row") == F.col("row")) & (F.col("first.line_no") == F.col("line_no"))
    match = F.when(own_first, F.col("match")).otherwise(F.col("first"))
    return lines.join(of_class, ["k1", "k2"]).select(
        "row",
        "doc_id",
        "line_no",
        F.col("n").cast("bigint").alias("n_tokens"),
        match.isNotNull().alias("removed"),
        match["doc_id"].alias("match_doc_id"),
        match["line_no"].alias("match_line"),
    )


def without_similar_lines(docs: DataFrame, percent: int = PERCENT, buckets: int = BUCKETS) -> DataFrame:
    """The documents without their removed lines; those of which no word is left are dropped."""
    gone = (
        judged_lines(docs, percent, buckets)
        .filter("removed")
        .groupBy(F.col("row").alias("_row"))
        .agg(F.collect_set("line_no").alias("_gone"))
    )
    joined = docs.join(stored(gone, "removed-lines"), _row_key() == F.col("_row"), "left")

    def rest(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(let(F.split("text", "\n"), rest))
    changed = joined.withColumn("text", text).filter(
        F.col("_gone").isNull() | F.col("text").rlike(r"[^ \t-\r]")
    )
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.length("text"))
        changed = changed.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)
