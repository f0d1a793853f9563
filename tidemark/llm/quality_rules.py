"""Quality rules by weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Every rule looks at the counts of one text and votes good (1), bad (-1) or abstains (0).
Each kind of fault (length, repetition, symbols, shouting) is seen by several rules, which
so confirm or contradict each other. The number of documents per combination of votes is
counted on Spark; as there are at most 3**len(RULES) combinations whatever the corpus, the
expectation-maximisation that estimates the share of good texts and how often each rule is
right on good and on bad ones runs on those counts. The posterior probability of a document
is then a sum of one weight per vote, a column expression. A rule that the others
contradict gets little weight or none, and a text that only it blames is kept.

Defined results: a null text counts as empty; an empty text has no words, fails the base
rules and is dropped; a text of any length is read whole; repeated rows are judged each by
itself, alike, and rows with the same votes tie; a posterior of exactly one half keeps; a
null id stays null; an empty table gives an empty result. Further columns of the input are
neither read nor needed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import let, stored, words_of

SHINGLE = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
KEEP_FROM = 0.5
#: Taken beforehand, as if seen on so many documents: the share of good texts, and the share
#: of good votes on good and on bad texts.
PRIOR_DOCS, SHARE_GOOD, GOOD_ON_GOOD, GOOD_ON_BAD = 10, 0.9, 0.95, 0.5


#: From this many different repeated windows on, they are found by sorting instead of look-up.
_FEW = 64


def _covered(places: Column, n: int) -> Column:
    """Words inside windows of ``n`` words that start at the places, given in order."""
    return let(
        places,
        lambda at: F.aggregate(
            F.transform(at, lambda p, i: F.least(F.lit(n), F.coalesce(F.get(at, i + 1) - p, F.lit(n)))),
            F.lit(0).cast("long"),
            lambda total, x: total + x,
        ),
    )


def _repeated(windows: Column, n: int) -> Column:
    """Words inside the windows that occur more than once, from the windows' hashes in order."""

    def by_sorting() -> Column:
        pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        again = let(
            F.sort_array(pairs),
            lambda found: F.filter(
                found,
                lambda p, i: (F.get(found, i - 1)["h"] == p["h"]).eqNullSafe(True)
                | (F.get(found, i + 1)["h"] == p["h"]).eqNullSafe(True),
            ),
        )
        return F.sort_array(F.transform(again, lambda p: p["i"]))

    def by_looking_up(twice: Column) -> Column:
        marked = F.transform(windows, lambda h, i: F.when(F.array_contains(twice, h), i))
        return F.filter(marked, lambda i: i.isNotNull())

    twice = let(
        F.sort_array(windows),
        lambda s: F.array_distinct(F.filter(s, lambda h, i: (F.get(s, i + 1) == h).eqNullSafe(True))),
    )
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(
        let(twice, lambda t: _covered(F.when(F.size(t) <= _FEW, by_looking_up(t)).otherwise(by_sorting()), n))
    )


def counts_of(text: Column) -> Column:
    """The counts of one text as a struct, each computed once."""
    text = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: of_hashes(words, h))

    def of_hashes(words: Column, h: Column) -> Column:
        windows = F.when(
            F.size(h) >= SHINGLE,
            F.transform(
                F.slice(h, 1, F.greatest(F.size(h) - (SHINGLE - 1), F.lit(0))),
                lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, SHINGLE))),
            ),
        ).otherwise(F.array().cast("array<bigint>"))
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            let(windows, lambda g: _repeated(g, SHINGLE)).alias("n_repeat_words"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>](?=[ \t-\r]|$)")).cast("long").alias("n_marked"),
            F.size(F.array_distinct(h)).cast("long").alias("n_distinct"),
            F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_exclaim"),
        )

    return let(words_of(text), of_words)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def _per_word(c: Column, name: str) -> Column:
    return c[name] / F.greatest(c["n_words"], F.lit(1))


def _per_char(c: Column, name: str) -> Column:
    return c[name] / F.greatest(c["word_chars"], F.lit(1))


def _monotonous(c: Column) -> Column:
    different, n = _per_word(c, "n_distinct"), c["n_words"]
    return ((different < 0.2) & (n <= 1000)) | ((different < 0.55) & (n <= 100))


#: Name and vote of every rule, each a function of the counts.
RULES: list[tuple[str, Callable[[Column], Column]]] = [
    ("length", lambda c: _vote(c["n_words"].between(50, 100_000), c["n_words"] < MIN_WORDS)),
    ("word_length", lambda c: _vote(_per_word(c, "word_chars").between(3, 10), ~_per_word(c, "word_chars").between(2, 18))),
    ("symbols", lambda c: _vote(_per_word(c, "n_symbols") <= 0.02, _per_word(c, "n_symbols") > 0.1)),
    ("symbol_share", lambda c: _vote(_per_char(c, "n_symbols") <= 0.004, _per_char(c, "n_symbols") > 0.02)),
    ("marked_words", lambda c: _vote(_per_word(c, "n_marked") <= 0.01, _per_word(c, "n_marked") > 0.05)),
    ("dup_lines", lambda c: _vote(c["n_dup_lines"] == 0, c["n_dup_lines"] * 5 > c["n_words"])),
    ("repeats", lambda c: _vote(_per_word(c, "n_repeat_words") <= 0.05, _per_word(c, "n_repeat_words") > 0.2)),
    ("varied", lambda c: _vote(_per_word(c, "n_distinct") >= 0.5, _monotonous(c))),
    ("upper", lambda c: _vote(_per_char(c, "n_upper") <= 0.2, _per_char(c, "n_upper") > 0.5)),
    ("exclaim", lambda c: _vote(_per_word(c, "n_exclaim") <= 0.05, _per_word(c, "n_exclaim") > 0.3)),
]


def votes_of(counts: Column) -> Column:
    return F.array(*(rule(counts).cast("int") for _, rule in RULES))


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[dict[int, float]]]:
    """Log odds of good beforehand, and for each rule the log odds that each vote adds.

    ``patterns`` has the number of documents per combination of votes. Each rule that does
    not abstain votes good with a chance of its own on good and on bad texts; these chances
    and the share of good texts are estimated in ``rounds`` of expectation and maximisation,
    with ``PRIOR_DOCS`` documents' worth of prior. An abstention adds nothing. No rule is
    taken to be worse than chance: a good vote never counts against a text, nor a bad vote
    for it.
    """
    total = sum(n for _, n in patterns)
    # To begin with, a text is taken as bad if any rule says so.
    good = [0.05 if -1 in votes else 0.95 for votes, _ in patterns]
    prior, odds = _logit(SHARE_GOOD), [{v: 0.0 for v in (-1, 0, 1)} for _ in RULES]
    for _ in range(rounds if total else 0):
        goods = sum(g * n for g, (_, n) in zip(good, patterns, strict=True))
        prior = _logit((goods + PRIOR_DOCS * SHARE_GOOD) / (total + PRIOR_DOCS))
        for j, by_vote in enumerate(odds):
            seen = {
                vote: (
                    sum(g * n for g, (votes, n) in zip(good, patterns, strict=True) if votes[j] == vote),
                    sum((1 - g) * n for g, (votes, n) in zip(good, patterns, strict=True) if votes[j] == vote),
                )
                for vote in (-1, 1)
            }
            on_good, on_bad = (
                (seen[1][k] + PRIOR_DOCS * before) / (seen[1][k] + seen[-1][k] + PRIOR_DOCS)
                for k, before in ((0, GOOD_ON_GOOD), (1, GOOD_ON_BAD))
            )
            by_vote[1] = max(0.0, math.log(on_good / on_bad))
            by_vote[-1] = min(0.0, math.log((1 - on_good) / (1 - on_bad)))
        logits = [prior + sum(odds[j][v] for j, v in enumerate(votes)) for votes, _ in patterns]
        good = [1 / (1 + math.exp(-max(-500.0, min(500.0, x)))) for x in logits]
    return prior, odds


def fit(votes: DataFrame) -> tuple[float, list[dict[int, float]]]:
    """The weights of the rules from the votes on all documents, one array per row.

    One row per combination of votes is read, 3**len(RULES) at most.
    """
    rows = votes.groupBy("votes").count().collect()
    return estimate([(tuple(r["votes"]), r["count"]) for r in sorted(rows, key=lambda r: r["votes"])])


def votes_of_text(text: Column) -> Column:
    return let(counts_of(text), votes_of)


def verdict(counts: Column, model: tuple[float, list[dict[int, float]]]) -> Column:
    """``base_failed``, ``quality`` (posterior of good) and ``kept``."""
    prior, odds = model
    base_failed = (counts["n_words"] < MIN_WORDS) | (
        100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"]
    )

    def weight(votes: Column) -> Column:
        total = F.lit(prior)
        for j, by_vote in enumerate(odds):
            total = total + F.when(votes[j] == 1, by_vote[1]).when(votes[j] == -1, by_vote[-1]).otherwise(by_vote[0])
        return 1 / (1 + F.exp(-total))

    return let(
        let(votes_of(counts), weight),
        lambda quality: F.struct(
            base_failed.alias("base_failed"),
            quality.alias("quality"),
            (~base_failed & (quality >= KEEP_FROM)).alias("kept"),
        ),
    )


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, ``base_failed``, ``kept`` and ``quality`` of every document.

    The counts, a few numbers per document, are stored, so that texts are read once.
    """
    counted = stored(docs.select("doc_id", counts_of(F.col("text")).alias("c")), "rule-counts")
    model = fit(counted.select(votes_of(F.col("c")).alias("votes")))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return counted.select("doc_id", "c", verdict(F.col("c"), model).alias("v")).select(
        "doc_id", *(F.col("c")[n].alias(n) for n in names), "v.base_failed", "v.kept", "v.quality"
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    Texts are counted twice, which is cheaper than to shuffle them to their counts.
    """
    model = fit(docs.select(votes_of_text(F.col("text")).alias("votes")))
    return docs.filter(let(counts_of(F.col("text")), lambda c: verdict(c, model))["kept"])
