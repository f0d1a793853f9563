"""Benchmark decontamination by a distributed positional inverted index.

Words are turned into 64-bit hashes, so the text is split once and compared as numbers.
The occurrences of test terms in the documents are counted first; each window of test
items is then looked up by its ``RAREST`` rarest terms. The index keeps a posting
(term, document, position) for every occurrence of such a term, as a table of the shared
folder. Offset-adjusted lists (position less the term's offset in the item) are
intersected per document, item and start; a start at which the rarest terms of a window
meet is a candidate. Candidates are confirmed word by word on the documents that have
any, so that matches are exact phrases. Terms of one item that meet at nearly the same
start, in any order or with words between, are counted as proximity matches.

Postings lie by document, never by term, so a term that every document has is no hot key.
Frames are marked for broadcast only after they were counted (see common).

Defined results: null texts and texts without words have no windows and no hits; an item of
fewer than ten words is one window, one without words none; item ids are compared as
strings, so equal ids of several items count once and null ids not at all; rows that share a doc_id
are told apart by their row text; a null doc_id stays null; an empty table on either side
gives no hit. Other columns than doc_id, item_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_broadcast, let, lower_ascii, stored

WINDOW = 10
RAREST = 2
#: Starts that are this near count as one place in proximity matches.
SLACK = 8
_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def term_hashes(text: Column) -> Column:
    """The hashes of a text's words, in order. Words: digits, letters, anything beyond ASCII."""
    words = F.split(F.coalesce(text, F.lit("")), _GAPS)
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(lower_ascii(w)))


def _row_key() -> Column:
    """Tells rows of one doc_id apart; rows alike in id and text may share it."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(item, w, term, at): the words of every window, ``at`` their place in the item."""
    length = F.size("terms")
    starts = F.when(length > 0, F.sequence(F.lit(0), F.greatest(length - window, F.lit(0))))
    return (
        items.select("item", "terms", F.explode(starts).alias("w"))
        .select("item", "w", F.posexplode(F.slice("terms", F.col("w") + 1, window)).alias("k", "term"))
        .select("item", "w", "term", (F.col("w") + F.col("k")).alias("at"))
    )


def _distinct_items(benchmark: DataFrame) -> DataFrame:
    """(item, terms, ids): each word sequence once, with the ids of the items that have it."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("id"), term_hashes(F.col("text")).alias("terms"))
    return rows.filter(F.size("terms") > 0).groupBy("terms").agg(F.sort_array(F.collect_set("id")).alias("ids")).select(
        F.xxhash64("terms").alias("item"), "terms", "ids"
    )


def _anchors(docs_terms: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(item, w, term, at): of each window the rarest terms by their occurrences in the documents."""
    windows = stored(_windows(items, window), "windows")
    vocabulary = stored(windows.select("term").distinct(), "test-terms")
    counted = (
        docs_terms.select(F.explode("terms").alias("term"))
        .join(bounded_broadcast(vocabulary), "term")
        .groupBy("term")
        .agg(F.count("*").alias("n"))
    )
    frequency = stored(vocabulary.join(counted, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n")), "frequency")
    ranked = windows.join(frequency, "term").groupBy("item", "w").agg(
        F.sort_array(F.collect_list(F.struct("n", "at", "term"))).alias("by_rarity")
    )
    # The window has ten words, so its list is bounded.
    return stored(
        ranked.filter(F.col("by_rarity")[0]["n"] > 0)
        .select("item", "w", F.explode(F.slice("by_rarity", 1, RAREST)).alias("a"))
        .select("item", "w", "a.term", "a.at"),
        "anchors",
    )


def _candidates(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(row, item, start, n_at, wanted...) where offset-adjusted postings of an item meet."""
    looked_up = bounded_broadcast(stored(anchors.select("term", "item", "at").distinct(), "look-ups"))
    return index.join(looked_up, "term").select("row", "item", (F.col("pos") - F.col("at")).alias("start"), "at")


def _confirmed(docs: DataFrame, found: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(row, item, hits): word places of a document inside windows of an item."""
    starts = found.groupBy("row", "item").agg(F.collect_set("start").alias("starts"))
    rows = docs.select(_row_key().alias("row"), "text")
    hit_rows = stored(found.select("row").distinct(), "candidate-rows")
    texts = rows.join(hit_rows, "row", "left_semi").dropDuplicates(["row"])
    texts = texts.select("row", term_hashes(F.col("text")).alias("doc"))
    joined = texts.join(starts, "row").join(bounded_broadcast(items.select("item", "terms"), 20_000), "item")

    def runs(doc: Column, terms: Column, start: Column) -> Column:
        """Places of the document that lie in a whole window found at this start."""
        last = F.size(terms) - F.least(F.lit(window), F.size(terms))
        same = F.transform(terms, lambda t, i: ((start + i >= 0) & (F.get(doc, start + i) == t)).eqNullSafe(True))
        wide = F.least(F.lit(window), F.size(terms))
        return let(
            same,
            lambda ok: F.flatten(
                F.transform(
                    F.filter(F.sequence(F.lit(0), last), lambda w: F.forall(F.slice(ok, w + 1, wide), lambda x: x)),
                    lambda w: F.sequence(start + w, start + w + wide - 1),
                )
            ),
        )

    return joined.select(
        "row",
        "item",
        F.array_distinct(
            F.flatten(F.transform("starts", lambda s: runs(F.col("doc"), F.col("terms"), s)))
        ).alias("hits"),
    ).filter(F.size("hits") > 0)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: its words, hit words, items found, and proximity matches."""
    items = stored(_distinct_items(benchmark), "items")
    plain = docs.select(_row_key().alias("row"), "doc_id", term_hashes(F.col("text")).alias("terms"))
    anchors = _anchors(plain, items, window)
    wanted = bounded_broadcast(stored(anchors.select("term").distinct(), "anchor-terms"))
    index = stored(
        plain.select("row", F.posexplode("terms").alias("pos", "term")).join(wanted, "term").select("term", "row", "pos"),
        "index",
    )
    found = stored(_candidates(index, anchors).distinct(), "adjusted")

    # A window is a candidate at a start where all its rarest terms are.
    per_window = anchors.groupBy("item", "w").agg(F.collect_set("at").alias("ats"))
    at_start = found.groupBy("row", "item", "start").agg(F.collect_set("at").alias("seen"))
    needs = per_window.groupBy("item").agg(F.collect_set("ats").alias("needs"))
    met = at_start.join(bounded_broadcast(stored(needs, "needs"), 20_000), "item").filter(
        F.exists("needs", lambda ats: F.size(F.array_except(ats, F.col("seen"))) == 0)
    )
    confirmed = stored(_confirmed(docs, stored(met.select("row", "item", "start"), "starts"), items, window), "confirmed")

    ids = confirmed.join(items.select("item", F.explode("ids").alias("id")), "item").select("row", "id").distinct()
    by_ids = ids.groupBy("row").agg(
        F.count("id").alias("n_items"), F.concat_ws(",", F.sort_array(F.collect_set("id"))).alias("item_list")
    )
    hits = confirmed.select("row", F.explode("hits").alias("pos")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    near = _proximity(found, anchors)
    counted = docs.select(_row_key().alias("row"), "doc_id", _n_words(F.col("text")).alias("n_words"))
    return counted.join(hits, "row", "left").join(by_ids, "row", "left").join(near, "row", "left").select(
        "row",
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("item_list", F.lit("")).alias("items"),
        F.coalesce("n_near_items", F.lit(0)).cast("bigint").alias("n_near_items"),
    )


def _n_words(text: Column) -> Column:
    words = F.split(F.coalesce(text, F.lit("")), _GAPS)
    return F.size(F.filter(words, lambda w: w != "")).cast("bigint")


def _proximity(found: DataFrame, anchors: DataFrame) -> DataFrame:
    """(row, n_near_items): items of which half the looked-up places, two at least, meet within the slack."""
    places = anchors.groupBy("item").agg(F.countDistinct("at").alias("places"))
    bands = found.select(
        "row", "item", "at", F.explode(F.array(F.floor(F.col("start") / SLACK), F.floor(F.col("start") / SLACK) + 1)).alias("band")
    )
    seen = bands.groupBy("row", "item", "band").agg(F.countDistinct("at").alias("seen"))
    near = seen.join(places, "item").filter((F.col("seen") >= 2) & (2 * F.col("seen") >= F.col("places")))
    return near.groupBy("row").agg(F.countDistinct("item").alias("n_near_items"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any occurrence of a benchmark window, all columns."""
    judged = contamination(docs, benchmark, window)
    hit = stored(judged.filter("n_hit > 0").select(F.col("row").alias("_hit_row")).distinct(), "contaminated")
    return docs.join(hit, _row_key() == F.col("_hit_row"), "left_anti")
