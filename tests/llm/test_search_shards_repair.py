"""Conversation repair, ranked search and token shards against brute force and on edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from functools import cache
from itertools import product

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversation_repair as repair
from tidemark.llm import ranked_search as search
from tidemark.llm import token_shards as shards
from tidemark.llm.queries import ORACLES, QUERIES
from tidemark.session import shared_dir

SF = "/root/testdata/sf0.001"
MESSAGES = "conv_id bigint, turn bigint, role string, text string"
SPACE = r"[^\x20\x09-\x0D]"


# Conversation repair


def faults_of(rows):
    """(initial, must go, truncated, fault) per message in order."""
    seen, out = set(), []
    for role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        if not bare:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated", fault))
    return out


def options(state, message):
    """(edit, cost, new state, initial made) in order of ASCII; states by the last initial."""
    initial, gone, cut, _ = message
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
    found = [("D", 3, state)]
    if not gone:
        if initial and initial in follows:
            found.append(("K", int(cut), initial))
        found.append(("R", 2 + cut, "a" if state == "u" else "u"))
    return found


def least(rows):
    """Cost and audit by cost-to-go and the least edit at every step."""
    messages = faults_of(rows)

    @cache
    def to_go(i, state, inserts=0):
        best = 0 if i == len(messages) and state in ("", "a") else math.inf
        if i < len(messages):
            best = min([best, *(c + to_go(i + 1, s) for _, c, s in options(state, messages[i]))])
        if inserts < 2:
            best = min(best, 2 + to_go(i, "a" if state == "u" else "u", inserts + 1))
        return best

    cost, audit, i, state, inserts = to_go(0, ""), "", 0, "", 0
    left = cost
    out = []
    while i < len(messages) or left:
        ways = [(e, c, s, i + 1, 0) for e, c, s in options(state, messages[i])] if i < len(messages) else []
        if inserts < 2:
            ways.append(("I", 2, "a" if state == "u" else "u", i, inserts + 1))
        for edit, c, s, k, n in sorted(ways):
            if c + to_go(k, s, n) == left:
                break
        role = {"s": "system", "u": "user", "a": "assistant"}.get(s, "")
        if edit in "RI":
            out.append((role, rows[i][1] if edit == "R" else ""))
        elif edit == "K":
            out.append(rows[i])
        audit, left, state, i, inserts = audit + edit, left - c, s, k, n
    return cost, audit, out


def exhaustive(rows):
    messages, best = faults_of(rows), None
    inserts = ["", "u", "a", "ua", "au"]
    for edits in product(*[["D"] if m[1] else ["D", "K", "Ru", "Ra"] for m in messages]):
        for gaps in product(inserts, repeat=len(messages) + 1):
            roles, audit, cost = gaps[0], "I" * len(gaps[0]), 2 * len(gaps[0])
            for edit, message, gap in zip(edits, messages, gaps[1:], strict=True):
                audit += edit[0] + "I" * len(gap)
                cost += {"D": 3, "K": 0, "R": 2}[edit[0]] + 2 * len(gap) + (message[2] and edit != "D")
                roles += {"D": "", "K": message[0] or "?"}.get(edit, edit[1:]) + gap
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def report_of(rows):
    """The report of one conversation from its (turn, role, text) rows in order."""
    cost, audit, out = least([r[1:] for r in rows])
    faults = Counter(m[3] for m in faults_of([r[1:] for r in rows]))
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest)


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kept = out.setdefault(conv, [])
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        kept += [(turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0], r[1], hashlib.md5(r[2].encode()).hexdigest()))
    return out


def reported(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def random_rows(rng, n):
    texts = ["Yes.", "No!", "so", "", " \t", "Why?", "a\nb. "]
    return [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}{rng.choice(['.', ''])}") for _ in range(n)]


def test_least_edits_are_those_of_all_edits():
    rng = random.Random(1)
    for n in (0, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3):
        rows = random_rows(rng, n)
        assert exhaustive(rows) == least(rows)[:2]


def test_hirschberg_finds_the_least_edits():
    rng = random.Random(2)
    kinds = {"s": 0, "u": 1, "a": 2}
    for n in [*range(12)] * 20 + [100, 257]:
        rows = random_rows(rng, n)
        codes = [8 if gone else kinds.get(i, 3) + 4 * cut for i, gone, cut, _ in faults_of(rows)]
        found: list[str] = []
        repair.edits_between([*codes, repair._END], 0, n + 1, repair.NOTHING, repair.NOTHING, found)
        assert "".join(found) == least(rows)[1]


@pytest.fixture
def uneven(spark):
    """Many ranges, also for few rows."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repair_of_conversations_over_several_ranges(spark, uneven):
    rng = random.Random(3)
    rows = [(conv, turn, role, text) for conv, n in ((1, 90), (2, 1), (None, 40), (4, 3)) for turn, (role, text) in enumerate(random_rows(rng, n))]
    messages = spark.createDataFrame(rows, MESSAGES).repartition(5).withColumn("copies", F.lit(1).cast("long"))
    want = {}
    for conv in {r[0] for r in rows}:
        want[conv] = report_of([r[1:] for r in rows if r[0] == conv])
    assert reported(repair.reports(messages)) == want
    # The repaired rows are those whose digest is reported.
    out = sorted(repair.repaired(messages).collect(), key=lambda r: (r["place"], r["step"]))
    for conv in want:
        text = "\n".join(f"{r['role']}:{r['text']}" for r in out if r["conv_id"] == conv)
        assert hashlib.sha256(text.encode()).hexdigest() == want[conv][-1]


def test_repair_of_damaged_table(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert reported(QUERIES["op13_conversation_repair"](spark, sf)) == {c: report_of(r) for c, r in damaged(rows).items()}


def test_repair_edge_cases(spark):
    long = "word " * 100_000
    rows = [(7, None, "user", "Hi."), (7, None, "assistant", None), (7, 3, None, "x."), (7, 3, None, "x."), (7, 9, "user", "Hi."), (8, 1, "user", long), (8, 1, "user", long),
            (None, 5, "assistant", "Yes."), (None, None, None, None), (9, 2**40, "", "a."), (9, -5, "assistant", "é!")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], MESSAGES + ", digest string, place int")
    assert reported(repair.reports(repair.damaged(df))) == {c: report_of(r) for c, r in damaged(rows).items()}
    assert repair.reports(repair.damaged(df.limit(0))).count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], MESSAGES)
    assert reported(repair.reports(repair.damaged(df))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


# Ranked search


def ranking(docs, queries, k=20):
    split = [(i, Counter(search.terms((t or "").encode()))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in split), sum(sum(c.values()) for _, c in split)
    df = Counter(t for _, c in split for t in c)
    out = []
    for item, text in queries:
        scores = []
        for doc_id, c in split:
            score = 0
            for t, times in Counter(search.terms((text or "").encode())).items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * ((10**9 * c[t]) // (1000 * c[t] + 12 * (75 + (25 * sum(c.values()) * n_docs) // total)))
            if score > 0:
                scores.append((-score, doc_id is not None, doc_id))
        out += [(item, rank, doc_id, -score) for rank, (score, _, doc_id) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def ranked(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_terms():
    for text in ("A-b_c'd é1 中文\x7f~Ω{ß}", "\x00a\x1cb", ""):
        want = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
        assert [w.decode() for w in search.terms(text.encode())] == want


def test_search_equals_sql(spark):
    duck = duckdb.connect()
    for sf in (SF, "/root/testdata/sf0.01"):
        for name in ("documents", "benchmark"):
            duck.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
        found = QUERIES["op12_ranked_search"](spark, sf)
        want = duck.sql(f"SELECT item_id, rank, doc_id, score FROM ({ORACLES['op12_ranked_search']})").fetchall()
        assert ranked(found) == sorted(want, key=str)


def test_search_with_ties_nulls_and_several_blocks(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 3, 3, 30])))) for i in range(300)]
    docs += [(5, "W1 w2!"), (5, "w1-w2"), (None, "w1 w2"), (None, "w1 w2"), (400, None), (401, " \t"), (402, "w3 " * 50_000)] + [(500 + i, "w1 w2 w3") for i in range(60)]
    queries = [(1, "w1 w2 w2 w3"), (1, "w1"), (None, "w5 w6 w7 w1"), (3, None), (4, "unknown"), (5, ""), (6, "w1 w2 w3 w4 w9 w11 w13 w1")]
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id bigint, text string, score string").repartition(3)
    q = spark.createDataFrame([(*r, "clash") for r in queries], "item_id bigint, text string, rank string")
    want = ranking(docs, queries)
    assert ranked(search.ranked(d, q)) == want
    monkeypatch.setattr(search, "QUERY_BYTES", 5)
    assert ranked(search.ranked(d, q)) == want
    assert ranked(search.ranked(d.limit(0), q)) == [] == ranked(search.ranked(d, q.limit(0)))


def test_query_blocks_hold_all_queries_in_bounded_bytes(spark):
    queries = [(i, "word " * (i % 5)) for i in range(50)]
    df = spark.createDataFrame(queries, "item_id bigint, text string").repartition(4)
    blocks = list(search.query_blocks(df, 40))
    assert sorted(item for b in blocks for item, _ in b) == list(range(50))
    assert all(sum(5 * (i % 5) for i, _ in b) <= 40 for b in blocks) and len(blocks) > 5


def test_best_positions_stop_early_and_keep_ties(monkeypatch):
    rng = np.random.default_rng(6)
    n_docs, n_terms, k = 4000, 6, 10
    pairs = [(d, t) for d in range(n_docs) for t in range(n_terms) if rng.random() < 0.4]
    doc, term = (np.array(x) for x in zip(*pairs, strict=True))
    impact = np.maximum(1, (1000 * rng.pareto(1.0, len(pairs)))).astype(np.int64) // 100 * 100
    lists = search.Lists(doc, term, impact, n_docs, n_terms)
    query = [(t, 1 + t % 2) for t in range(n_terms)]
    scores = np.zeros(n_docs, np.int64)
    for t, times in query:
        scores[doc[term == t]] += times * impact[term == t]
    want = [(int(scores[d]), int(d)) for d in np.lexsort((np.arange(n_docs), -scores))[:k]]
    looked = []
    real = np.flatnonzero
    monkeypatch.setattr(search.np, "flatnonzero", lambda x: looked.append(len(real(x))) or real(x))
    assert lists.best(query, k, 0) == want
    assert 0 < sum(looked) < n_docs / 2
    # Documents that only reach the k-th score of earlier blocks are still found, lower ones are not.
    kth = want[3][0]
    assert lists.best(query, k, kth) == [w for w in want if w[0] >= kth]
    flat = search.Lists(doc, term, np.full(len(pairs), 100), n_docs, n_terms)
    ties = Counter(doc.tolist())
    assert flat.best([(t, 1) for t in range(n_terms)], k, 0) == sorted(((100 * c, d) for d, c in ties.items()), key=lambda x: (-x[0], x[1]))[:k]


# Token shards


def test_index_is_minimal_and_perfect(monkeypatch):
    rng = np.random.default_rng(7)
    for n, levels in ((0, 64), (1, 64), (1000, 64), (70_000, 64), (500, 1)):
        monkeypatch.setattr(shards, "_LEVELS", levels)
        hashes = rng.integers(0, 2**63, n).astype(np.uint64)
        names = [str(i) for i in range(n)]
        slots = np.zeros(n, shards._SLOT)
        slots["first"] = np.arange(n)
        index = shards.Index.from_bytes(shards.Index.built(hashes, names, slots).to_bytes())
        assert sorted(index.slot(hashes, names)) == list(range(n))
        known, found = index.find(hashes, names)
        assert known.all() and (found["first"] == np.arange(n)).all()
        assert bool(index.rest) == (levels == 1)
        others = rng.integers(0, 2**63, 1000).astype(np.uint64)
        assert not index.find(others, ["x"] * 1000)[0].any()
    twice = shards.Index.built(np.array([5, 5, 6], np.uint64), ["a", "b", "c"], np.zeros(3, shards._SLOT))
    assert len(set(twice.slot(np.array([5, 5, 6], np.uint64), ["a", "b", "c"]))) == 3


def encoded(texts):
    tokenizer = shards._tokenizer(shards.tokenizer_path())
    return [[*e.ids, shards.END_ID] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_shards_equal_whole_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()
    found = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_token_shards"](spark, "/root/testdata/sf0.01").collect()}
    start, want = 0, {}
    for row, ids in zip(docs, encoded([r["text"] for r in docs]), strict=True):
        want[row["doc_id"]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert found == want


def test_words_of_letters_are_encoded_between_spaces_and_without_offsets(monkeypatch):
    encoder = shards.Encoder(shards.tokenizer_path(), 2)
    texts = [
        "plain Words, ünd Straße Σας ΑΣ 中文 한국어 \u1112\u1161\u11ab ａｂ ﬁ ǅ ª don't x9 <|endoftext|> a<|endoftext|>b</w> w>",
        *("İ x İstanbul", "i\u0307 e\u0301 \u0301", "\U0001d400\u2f00 \u212b", " ".join(f"{a}{b}{a}ly" for a in "qwxyz" for b in "aeiou")),
    ]
    seen, ids_of = [], encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda text: seen.append(text) or ids_of(text))
    found = [np.frombuffer(data, "<u2").tolist() for data in encoder.encode(texts)]
    assert encoder.by_piece and found == encoded(texts)
    assert any("qaqly" in text and encoder.bar not in text for text in seen)


def test_token_shards_of_repeated_null_and_odd_rows(spark, uneven):
    odd = ["a\x1cb\x85c d é ́x Σας İ <|endoftext|>x <|startoftext|> 's don't\r\n\t...", "x" * 300_000, "中文 " * 1000, "  \n ", "", None]
    rows = [(i, t) for i, t in enumerate(odd)] + [(3, "again"), (None, "no id"), (None, None), (-7, "below")] + [(50, "same text")] * 30 + [(50, f"other {i}") for i in range(30)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, file string, start int").repartition(4)
    store = shards.written(docs, shared_dir(spark, "store"), keys_per_file=20)
    assert store.width == 2 and store.index(spark).count() == 4
    found = shards.fetched(store, docs.select("doc_id"), with_ids=True).collect()
    by_id = sorted(zip((r[0] for r in rows), encoded([r[1] for r in rows]), strict=True), key=str)
    assert sorted(((r["doc_id"], r["ids"]) for r in found), key=str) == by_id
    ordered = sorted(found, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0] + [r["n_tokens"] for r in ordered])[:-1].tolist()
    assert [r["doc_id"] for r in ordered] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    for doc_id in {r[0] for r in rows}:
        assert [r["copy"] for r in ordered if r["doc_id"] == doc_id] == list(range(sum(r[0] == doc_id for r in rows)))
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["n_tokens"] for r in found)
    client = shards.Client(spark, store)
    for row in found:
        assert client.ids(row["doc_id"], row["copy"]) == row["ids"]
    assert client.ids(999) is None and client.ids(50, 60) is None
    unknown = spark.createDataFrame([(999,), (-7,)], "doc_id bigint")
    assert [r["doc_id"] for r in shards.fetched(store, unknown).collect()] == [-7]
    empty = shards.written(docs.limit(0), shared_dir(spark, "store"))
    assert shards.fetched(empty, docs.select("doc_id")).count() == 0 and shards.Client(spark, empty).ids(1) is None
