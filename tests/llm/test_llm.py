"""The operators on small hand-made rows, against brute force, and the queries against SQL."""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import cotraining, decontamination, gru, license_scan, line_dedup, lm_scoring, near_dedup, packing, pii, quality_rules, reply_trees
from tidemark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, n string"
A = " ".join(f"alpha{i}" for i in range(60))
B = " ".join(f"alpha{i}" for i in range(57)) + " x y z"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
TEXTS = [(1, A), (2, B), (3, A), (4, None), (5, ""), (6, LONG), (7, "one"), (8, "other words\nother words"), (8, "other words\nother words"),
         (None, A), (9, "Call +49 151 2345 6789 or a.b@c.example.com from 10.0.0.1"), (10, " \t\n")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None, len(t or ""), "clash", None) for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for got in (
        pii.personal_data(empty), line_dedup.judged_lines(empty), packing.packed(empty), cotraining.classified(empty, labels),
        decontamination.contamination(empty, bench), license_scan.licenses(empty), lm_scoring.scored(empty),
        quality_rules.judge(empty), near_dedup.groups(empty), near_dedup.one_of_each(empty),
        line_dedup.without_similar_lines(empty), quality_rules.keep_good(empty),
    ):
        assert got.count() == 0


def test_rules_count_and_keep(docs):
    got = {(r["doc_id"], r["n_words"]): r for r in quality_rules.judge(docs).collect()}
    for doc_id, text in TEXTS:
        found = words(text)
        windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
        seen = Counter(windows)
        covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 5)}
        r = got[doc_id, len(found)]
        assert (r["word_chars"], r["n_repeat_words"]) == (sum(map(len, found)), len(covered))
        assert r["base_failed"] == (len(found) < 10 or 100 * len(covered) > 20 * len(found))
    assert got[1, 60]["kept"] and not got[7, 1]["kept"]


def test_rules_count_every_text_of_a_table(spark):
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        found, r = words(text), got[doc_id]
        windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
        seen = Counter(windows)
        covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 5)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        counts = (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        assert tuple(r[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == counts
        assert r["base_failed"] == (len(found) < 10 or 100 * len(covered) > 20 * len(found))
        assert not (r["kept"] and r["base_failed"])


def _em_by_document(votes, rounds):
    """Accuracies by expectation-maximisation over documents instead of combinations."""
    good = np.where((votes == -1).any(axis=1), 0.05, 0.95)
    s = quality_rules.PRIOR_DOCS
    for _ in range(rounds):
        share = (good.sum() + s * quality_rules.SHARE_GOOD) / (len(votes) + s)
        up, down = votes == 1, votes == -1
        on_good = (good @ up + s * quality_rules.GOOD_ON_GOOD) / (good @ (up | down) + s)
        on_bad = ((1 - good) @ up + s * quality_rules.GOOD_ON_BAD) / ((1 - good) @ (up | down) + s)
        plus, minus = np.maximum(0, np.log(on_good / on_bad)), np.minimum(0, np.log((1 - on_good) / (1 - on_bad)))
        logits = np.log(share / (1 - share)) + up @ plus + down @ minus
        good = 1 / (1 + np.exp(-logits))
    return share, plus, minus


def _votes_with_a_noisy_rule(n=4000):
    """A tenth of the texts is bad; all rules but the last tell it mostly, that one blames any text at random."""
    rng = np.random.default_rng(11)
    bad, k = rng.random(n) < 0.1, len(quality_rules.RULES)
    right = rng.random((n, k)) < 0.9
    votes = np.where(right, np.where(bad, -1, 1)[:, None], np.where(rng.random((n, k)) < 0.8, 0, np.where(bad, 1, -1)[:, None]))
    votes[:, -1] = np.where(rng.random(n) < 0.3, -1, 1)
    return bad, votes


def test_rules_are_weighed_as_by_brute_force():
    _, votes = _votes_with_a_noisy_rule()
    prior, odds = quality_rules.estimate(sorted(Counter(map(tuple, votes.tolist())).items()), rounds=30)
    share, plus, minus = _em_by_document(votes, 30)
    assert prior == pytest.approx(math.log(share / (1 - share)))
    assert [o[1] for o in odds] == pytest.approx(plus.tolist()) and [o[-1] for o in odds] == pytest.approx(minus.tolist())
    assert quality_rules.estimate([])[1] == [{-1: 0.0, 0: 0.0, 1: 0.0}] * len(odds)


def test_a_rule_that_the_others_contradict_is_outvoted():
    bad, votes = _votes_with_a_noisy_rule()
    prior, odds = quality_rules.estimate(sorted(Counter(map(tuple, votes.tolist())).items()))
    assert 1 / (1 + math.exp(-prior)) == pytest.approx(1 - bad.mean(), abs=0.01)
    assert abs(odds[-1][-1]) < 0.3 and all(o[-1] < -2 for o in odds[:-1])
    logits = prior + sum(np.select([votes[:, j] == 1, votes[:, j] == -1], [o[1], o[-1]], 0.0) for j, o in enumerate(odds))
    assert np.mean((logits < 0) == bad) > 0.999
    blamed = (votes[:, -1] == -1) & (votes[:, :-1] >= 0).all(axis=1) & ~bad
    assert blamed.sum() > 100 and (logits[blamed] >= 0).all()


def test_rules_keep_good_and_drop_bad_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").selectExpr("doc_id", "quality = 1 AS good")
    judged = quality_rules.judge(docs).join(labels, "doc_id").filter("NOT base_failed").collect()
    assert np.mean([r["kept"] == r["good"] for r in judged]) > 0.98
    assert np.mean([r["kept"] for r in judged if r["good"]]) > 0.99
    kept = quality_rules.judge(docs).filter("kept").select("doc_id")
    assert sorted(kept.collect()) == sorted(quality_rules.keep_good(docs).select("doc_id").collect())


def test_near_dedup(docs):
    got = near_dedup.groups(docs, shingle=2).collect()
    component = {r["doc_id"]: r["component_id"] for r in got}
    assert len(got) == len(TEXTS)
    assert component == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9, 10: 10, None: None}


def test_near_dedup_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {r["doc_id"]: set(zip(w, w[1:], strict=False)) if len(w := words((r["text"] or "").lower())) > 1 else set(w) for r in docs.collect()}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 80 * len(sets[i] | sets[j]):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.groups(docs, shingle=2).collect()}
    assert got == {i: top(i) for i in sets}


def test_node_blocks_give_a_forest_of_links():
    import pandas as pd

    sets = [np.arange(k, k + 20, dtype=np.uint64) for k in (0, 1, 2, 500)]
    rows = pd.DataFrame({"id": [1, 2, 3, 4], "component": [1, 2, 3, 4], "found": [s.tobytes() for s in sets]})
    got = near_dedup._block_links(8, 80)(rows)
    assert sorted(map(tuple, got.to_numpy().tolist())) == [(1, 2), (1, 3)]


def test_line_dedup_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lines = [
        (r["doc_id"], i, set(words(line)))
        for r in sorted(docs.collect(), key=lambda r: r["doc_id"])
        for i, line in enumerate((r["text"] or "").split("\n"))
        if words(line)
    ]
    want, before = {}, []
    for doc_id, i, s in lines:
        want[doc_id, i] = any(180 * len(s & x) >= 80 * (len(s) + len(x)) for x in before)
        before.append(s)
    got = {(r["doc_id"], r["line_no"]): r["removed"] for r in line_dedup.judged_lines(docs).collect()}
    assert got == want


def test_line_dedup_rarity_is_finer_for_more_words(spark):
    text = F.expr("array_join(transform(sequence(1, 20), k -> concat('w', id * 20 + k)), ' ') || ' the'")
    rows = spark.range(400).select(F.col("id").alias("doc_id"), text.alias("text"))
    few, many = line_dedup.rarity(rows.limit(20), 8, 1024), line_dedup.rarity(rows, 8, 1024)
    assert (len(few), len(many)) == (8, 128)
    # One bucket holds the frequent word, the others about 62 rare ones each.
    assert sorted(many)[-1] >= 26 and sorted(many)[-2] < 22


def test_line_dedup_gives_one_match_a_line_in_groups_of_near_copies(spark):
    base = [f"w{k}" for k in range(40)]
    rows = [(d, " ".join([*base, f"a{d}", f"b{d % 7}"])) for d in range(150)] + [(200, " ".join(f"u{k}" for k in range(40)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r for r in line_dedup.judged_lines(docs).collect()}
    assert len(got) == 151 and not got[0]["removed"] and not got[200]["removed"]
    assert all(got[d]["removed"] and got[d]["match_doc_id"] < d for d in range(1, 150))


def test_line_dedup_keeps_columns_and_first_lines(docs):
    got = line_dedup.without_similar_lines(docs)
    assert got.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts[None] == A and 1 not in texts and texts[8] == "other words" and texts[4] is None


def test_packing_boundaries_are_optimal():
    from itertools import combinations

    edges, counts = [8, 16, 24, 40, 80, 96, 200], [5, 1, 7, 3, 2, 9, 1]

    def padded(ends):
        return sum(c * min(e for e in ends if e >= x) for x, c in zip(edges, counts, strict=True))

    best = min(padded((*c, 200)) for c in combinations(edges[:-1], 2))
    assert padded(packing.boundaries(edges, counts, 3)) == best


def test_packing_pads_to_lengths_that_occur(spark):
    lengths = [9] * 4 + [30] * 3 + [10_001] * 2 + [10_003]
    docs = spark.createDataFrame([(k, "w " * n) for k, n in enumerate(lengths)], "doc_id bigint, text string")
    got = {(r["n_tokens"], r["padded_len"]) for r in packing.packed(docs, buckets=3).collect()}
    assert got == {(9, 9), (30, 30), (10_001, 10_003), (10_003, 10_003)}


def test_packing_fills_batches(docs):
    rows = packing.packed(docs, buckets=3, token_budget=400, shard_rows=2).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert (r["bucket"] is None) == (r["n_tokens"] == 0)
    sizes = Counter((r["bucket"], r["batch"]) for r in rows if r["n_tokens"])
    for r in rows:
        if r["n_tokens"]:
            assert r["padded_len"] >= r["n_tokens"]
            assert sizes[r["bucket"], r["batch"]] <= max(1, 400 // r["padded_len"])


def test_reply_trees_pick_the_best_branch_and_read_back(spark):
    rows = [("t", 1, None, "user", "a\\<|im_end|>\n<\\|", 0.0), ("t", 2, 1, "assistant", None, 0.1), ("t", 3, 1, "assistant", "best", 0.9),
            ("t", 4, 3, "odd role\n", "x", 0.9), (None, 1, 7, None, "root by a missing parent", None)]
    messages = spark.createDataFrame(rows, "tree string, node bigint, parent bigint, role string, text string, score double")
    found = reply_trees.conversations(messages, branches=2)
    turns = {(r["tree"], r["rank"]): r["turns"] for r in found.select("tree", "rank", reply_trees.read_back(F.col("formatted")).alias("turns")).collect()}
    assert [(t["role"], t["text"]) for t in turns["t", 1]] == [("user", "a\\<|im_end|>\n<\\|"), ("assistant", "best"), ("odd role\n", "x")]
    assert [t["text"] for t in turns["t", 2]] == ["a\\<|im_end|>\n<\\|", ""]
    assert [t["text"] for t in turns[None, 1]] == ["root by a missing parent"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = QUERIES[name](spark, SF).toPandas()
    want = con.sql(ORACLES[name]).df()[list(got.columns)]
    key = got.columns[0]
    got, want = (x.sort_values(key).reset_index(drop=True).astype(str) for x in (got, want))
    assert got.equals(want)


def test_pii_base_and_added_spans(docs):
    r = next(r for r in pii.personal_data(docs).collect() if r["doc_id"] == 9)
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 0, 1)
    train = [f"reach +4915{k:08d} now\nor write n{k}@host{k}.example.com about {k} things, {k % 9}" for k in range(10**7, 10**7 + 200)]
    train += [t + f"\nagain {t.split()[1]}" for t in train]
    model = pii.Model().fit(train)
    text = "phone +491512345678 is good. Later: 491512345678 rings, 12 times"
    assert ("phone", text.index(" 4915") + 1, text.index(" rings")) in model.added(text, pii.base_spans(text))
    assert model.added("12 eggs and 7 spoons", pii.base_spans("12 eggs and 7 spoons")) == []


def _phone_lines(n):
    train = [f"reach +4915{k:08d} now\nor write n{k}@host{k}.example.com about {k} things, {k % 9}" for k in range(10**7, 10**7 + n)]
    return [*train, *(t + f"\nagain {t.split()[1]}" for t in train)]


def test_pii_long_documents_are_one_field_and_are_learned_from(spark):
    model = pii.Model().fit(_phone_lines(200))
    text = "phone +491512345678 is good. " + "then 7 x " * 21_000 + "Later: 491512345678 rings"
    assert ("phone", text.index(" 4915") + 1, text.index(" rings")) in model.added(text, pii.base_spans(text))
    long = [(k, t + " x" * 12_000) for k, t in enumerate(_phone_lines(20))]
    assert pii.fitted(spark.createDataFrame(long, "doc_id bigint, text string")).skip.any()


def test_pii_spaced_numbers_repeated_without_prefix():
    train = [f"reach +49 1{k % 90 + 10} {k % 8999 + 1000} {k * 7 % 8999 + 1000} now\nor write n{k}@host{k}.example.com, {k % 70} of {k % 9}" + f" in {k}" * (k % 3 == 0) for k in range(3000, 3200)]
    train += [f"{t}\nagain {t[6:23]}" for t in train]
    model = pii.Model().fit(train)
    for first, again in (("+49 151 2345 6789", "49 151 2345 6789"), ("+491512345678", "49 151 234 5678"), ("+49 151 2345 6789", "4915123456789")):
        text = f"phone {first} is good, 49 eggs of 2345. Later: 12 things rang {again} twice"
        base, spans = pii.base_spans(text), pii.nodes(text)
        at = text.index(f"rang {again} ") + 5
        clamped = {i for i, x in enumerate(pii._labels(spans, base)) if x}
        reached = {int(j) for i, j in pii.edges(text, spans, base)[1] if i in clamped}
        assert reached == {j for j, (s, e) in enumerate(spans) if at <= s and e <= at + len(again)}, again
        assert model.added(text, base) == [("phone", at, at + len(again))], (again, model.added(text, base))
    card = "card 4111 1111 1111 1111 here; later 4111-1111 1111-1111 and 4111 1111 1111 1112"
    base, spans = pii.base_spans(card), pii.nodes(card)
    assert len(base["card"]) == 2
    assert sorted(map(tuple, pii.edges(card, spans, base)[1].tolist())) == [(0, 4), (1, 4), (2, 5), (3, 5)]


def test_marginals_are_exact_on_a_chain():
    rng = np.random.default_rng(0)
    unary, pair = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    edges = np.array([[0, 1], [1, 2], [2, 3]])
    got = pii.marginals(unary, [(edges, pair), (np.zeros((0, 2), np.int64), pair)], rounds=60)
    want = np.zeros((4, 3))
    for x in np.ndindex(3, 3, 3, 3):
        p = math.exp(sum(unary[i, x[i]] for i in range(4)) + sum(pair[x[i], x[i + 1]] for i in range(3)))
        for i in range(4):
            want[i, x[i]] += p
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=1e-6)


def test_license_spans(spark):
    full = license_scan.TEMPLATES["mit"].replace("free of charge", "at no charge at all")
    rows = [(1, f"é {full} end"), (2, None), (3, "Licensed under CC BY-NC 4.0."), (4, "nothing here at all")]
    got = {(r["doc_id"], r["template"]): r for r in license_scan.licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert set(got) == {(1, "mit"), (3, "cc-by-nc-4.0-line")}
    assert got[1, "mit"]["start"] == 2 and 0.9 < got[1, "mit"]["coverage"] < 1


def test_license_spans_of_lines_repeated_back_to_back():
    index = license_scan.Index(license_scan.TEMPLATES)
    for name, n in (("all-rights-reserved", 3), ("mit-line", 5), ("cc-by-nc-4.0-line", 7), ("apache-2.0-line", 8)):
        assert len(index.words[name]) == n
        for copies in (1, 2, 3, 7, 40):
            text = "see also " + " ".join([license_scan.TEMPLATES[name]] * copies) + " thanks"
            got = [(k[1], k[2]) for k in index.matches(text.encode(), license_scan.COVERAGE) if k[0] == name]
            assert got == [(2 + n * k, 1 + n * (k + 1)) for k in range(copies)], (name, copies)


def test_gradients_and_probabilities(monkeypatch):
    monkeypatch.setattr(gru, "LANES", 2)
    rng = np.random.default_rng(0)
    params = {k: v.astype(np.float64) * 3 for k, v in gru.initial(11, 5).items()}
    docs = [rng.integers(0, 9, n) for n in (5, 1, 0, 9)]
    inputs, targets, of, goes_on = next(gru._windows(docs, 9))
    args = inputs, targets, of >= 0, goes_on, np.zeros((2, 5))
    _, grads, _ = gru.window_gradient(params, *args)
    for name, value in params.items():
        at = tuple(rng.integers(0, s) for s in value.shape)
        losses = []
        for step in (1e-3, -1e-3):
            moved = value.copy()
            moved[at] += step
            losses.append(gru.window_gradient({**params, name: moved}, *args)[0])
        assert abs(grads[name][at] - (losses[0] - losses[1]) / 2e-3) < 1e-2
    state = rng.normal(size=(1, 5))
    assert abs(sum(np.exp(gru._output(params, state, np.array([t]), None)[0][0]) for t in range(11)) - 1) < 1e-6


def test_output_takes_classes_together_and_bears_large_logits(monkeypatch):
    rng = np.random.default_rng(4)
    params = gru.initial(398, 16)
    targets = np.append(np.repeat([5, 397], 900), rng.integers(0, 398, 600))
    states = rng.normal(size=(len(targets), 16)).astype(np.float32)
    calls, exp = [], gru._exp
    monkeypatch.setattr(gru, "_exp", lambda x: calls.append(len(x)) or exp(x))
    for scale in (1, 400):
        p = {k: v * np.float32(scale) for k, v in params.items()}
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        logs, back = gru._output(p, states, targets, grads)
        found, want = gru._output(p, states, targets, None)[0], []
        for h, t in zip(states.astype(np.float64), targets, strict=True):
            k, at = divmod(t, 20)
            inside = (p["token_w"][k] @ h + p["token_b"][k])[: 398 - 20 * k]
            by_class = h @ p["class_w"] + p["class_b"]
            want.append(by_class[k] - np.logaddexp.reduce(by_class) + inside[at] - np.logaddexp.reduce(inside))
        assert np.allclose(logs, want, atol=1e-3 * scale) and np.allclose(found, logs, atol=1e-3 * scale)
        assert np.isfinite(back).all() and not grads["token_w"][-1, 18:].any()
    # The classes, two frequent ones, and all others at once; not each of twenty.
    assert len(calls) <= 4 * 4


def test_lm_base_scores(docs):
    import zlib

    tokens = [(i, [*words((t or "").lower()), None]) for i, t in TEXTS]
    counts = Counter(w for i, t in tokens if zlib.crc32(str(i if i is not None else "").encode()) % 7 != 2 for w in t)
    n, v = sum(counts.values()), len(counts)
    want = sorted(round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 4) for _, t in tokens)
    got = lm_scoring.scored(docs).collect()
    assert sorted(round(r["base_score"], 4) for r in got) == want
    assert all(r["score"] < 0 and r["train_tokens"] == n for r in got)


def test_cotraining_tells_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = cotraining.classified(docs, labels.filter("doc_id % 3 <> 0")).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    assert np.mean([(r["score"] >= 0.5) == bool(r["quality"]) for r in scored]) > 0.95
    toxic = [r["toxic_score"] >= 0.5 for r in scored if r["toxic"] == 1]
    assert np.mean(toxic) > 0.5 and not any(r["toxic_score"] >= 0.5 for r in scored if r["toxic"] == 0)


LABELS = "doc_id bigint, quality int, toxic int"


def _planted(spark):
    """Labelled documents tell good from bad by word and source; the words of the others occur in no labelled one."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(1200):
        good, labelled = i % 2, i < 400
        sign = ("fine", "awful") if labelled else ("fresh", "rotten")
        filler = " ".join(f"w{k}" for k in rng.integers(0, 40, 12))
        # The metadata of one in twenty is wrong.
        source = "ab"[good ^ int(rng.random() < 0.05)]
        rows.append((i, f"{filler} {sign[0] if good else sign[1]}", "en", source))
        if labelled:
            labels.append((i, good, 0))
    for i, word in ((5000, "fresh"), (5001, "rotten")):
        rows.append((i, f"w1 w2 w3 w4 w5 w6 w7 w8 {word}", "en", "elsewhere"))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), spark.createDataFrame(labels, LABELS)


def test_cotraining_learns_words_of_unlabelled_documents_only(spark):
    docs, labels = _planted(spark)

    def scores(rounds, parts):
        return {r["doc_id"]: (r["score"], r["toxic_score"]) for r in cotraining.classified(docs.repartition(parts), labels, rounds).collect()}

    alone, exchanged = scores(0, 3), scores(2, 3)
    assert alone[5000] == alone[5001]
    assert exchanged[5000][0] > 0.6 and exchanged[5000][0] - exchanged[5001][0] > 0.3
    # Counts are exact, so that partitions do not matter.
    assert exchanged == scores(2, 7)


def test_cotraining_counts_against_brute_force(spark):
    docs, labels = _planted(spark)
    seen = cotraining.views(docs, labels)
    none = cotraining.Models(
        {c: {f: np.zeros(1 << b) for f, b in cotraining.BITS.items()} for c in cotraining.LABELS}, {c: dict.fromkeys(cotraining.VIEWS, 0.0) for c in cotraining.LABELS}, {}
    )
    got = cotraining._weighed(seen, none, {})["quality"]["word"]
    held = {r["doc_id"] for r in seen.filter("held").collect()}
    label = {r["doc_id"]: r["quality"] for r in labels.collect()}
    counts = (Counter(), Counter())
    for r in docs.collect():
        if r["doc_id"] in label and r["doc_id"] not in held:
            counts[label[r["doc_id"]]].update(set(r["text"].split()))
    all0, all1 = (sum(c.values()) for c in counts)
    expected = 0
    for word in counts[0] | counts[1]:
        n0, n1 = counts[0][word], counts[1][word]
        pooled = (n0 + n1) / (all0 + all1)
        told = 2 * sum(n * math.log(n / (t * pooled)) for n, t in ((n0, all0), (n1, all1)) if n)
        w = math.log((n1 + 0.5) / (all1 + 0.5 / pooled) / ((n0 + 0.5) / (all0 + 0.5 / pooled))) if told > cotraining.EVIDENCE else 0.0
        expected += w != 0
        place = np.frombuffer(cotraining.word_view([word.encode()]), np.int32)[0]
        assert got[place] == pytest.approx(w), word
    assert expected == (got != 0).sum() > 0


@given(st.dictionaries(st.integers(-200, 200), st.integers(1, 50), min_size=1), st.floats(0, 1), st.floats(0, 1))
@settings(max_examples=200, deadline=None)
def test_cotraining_cuts_reach_the_fraction_or_the_least_surety(cells, share, fraction):
    low, high = cotraining.cuts_of(cells, share, fraction)
    total = sum(cells.values())
    assert low <= -cotraining.SURE and high >= cotraining.SURE
    above = sum(n for cell, n in cells.items() if cell / cotraining.CELLS >= high)
    below = sum(n for cell, n in cells.items() if cell / cotraining.CELLS < low)
    assert high == cotraining.SURE or above >= fraction * share * total
    assert low == -cotraining.SURE or below >= fraction * (1 - share) * total


def test_cotraining_edge_rows(spark, docs):
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 0, None), (2, None, None), (3, 1, 1), (8, 0, 0), (None, 1, 1), (99, 0, 0)], LABELS
    ).selectExpr("*", "'clash' AS source", "'clash' AS text")
    got = cotraining.classified(docs, labels).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got) == sorted((i is not None, i or 0) for i, _ in TEXTS)
    assert all(0 <= r["score"] <= 1 and r["kept"] is not None for r in got)
    unlabelled = cotraining.classified(docs, labels.limit(0)).collect()
    assert {(r["score"], r["toxic_score"], r["kept"]) for r in unlabelled} == {(0.5, 0.5, True)}
    seen = {r["doc_id"]: (r["quality"], r["toxic"]) for r in cotraining.views(docs, labels).collect()}
    assert seen[1] == (0, 0) and seen[2] == (-1, -1) and seen[None] == (-1, -1) and seen[3] == (1, 1)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        assert out.count() <= docs.count()
        docs = spark.createDataFrame(out.collect(), out.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.count() == docs.count()


def test_near_dedup_pair_at_the_threshold_stays_together_down_to_the_last_level(spark):
    rng, n = np.random.default_rng(5), 300
    a = rng.integers(0, 2**31, (n, near_dedup.POSITIONS))
    b = np.where(rng.random(a.shape) < 0.8, a, rng.integers(0, 2**31, a.shape))
    x, y = (
        spark.createDataFrame([(k, [int(v) for v in m]) for k, m in enumerate(mins)], "pair int, mins array<int>")
        .select("pair", near_dedup._paths().alias(f"{side}_keys"), F.col("mins").alias(side))
        for side, mins in (("a", a), ("b", b))
    )
    walk = x.join(y, "pair").select("pair", "a", "b", F.explode(F.array_intersect("a_keys", "b_keys")).alias("key"))
    for _ in range(near_dedup.LEVELS - 1):
        below = (near_dedup._branched(F.col("key"), F.col(side)) for side in ("a", "b"))
        walk = walk.select("pair", "a", "b", F.explode(F.array_intersect(*below)).alias("key")).localCheckpoint()
    together = walk.select("pair").distinct().count()
    assert together >= 0.93 * n, together
