"""Personal data by patterns and a skip-chain conditional random field.

Base spans come from patterns for e-mail addresses, IPv4 addresses, card numbers and
phone numbers. The random field adds spans the patterns miss, such as a second mention of
a number without its prefix. Its nodes are the tokens with a digit or ``@``; tokens
without are fixed to "other", which cuts the chain, so that they need no messages. Its
edges join neighbouring nodes (the chain) and each mention of a token to the next
similar one anywhere in the document (the skips; similar: alike once case and
punctuation are dropped, from 5 characters on, or places of a number of 5 digits or more
that is written over a run of nodes, with the same digits; a short part of a number, such as
its country code, is similar to nothing by itself, and an IPv4 address is a token of its own). Loopy belief propagation gives every node's marginals; an
added span is a run of nodes of one label, of at least ``SURE`` probability each, which
touches no base span. Nodes inside base spans are clamped to their label.

The weights are fitted by pseudo-likelihood on ``FIT_DOCS`` documents, of any length, that
have likely base spans, chosen by a hash of id and text (and repeats of the last one); base
spans are the labels. Their nodes are counted in tasks, by what the fit sees of them, so
that only distinct ones and their counts come together. A document is one field, whatever
its length: its edges span all of it, and messages are worked on in blocks of edges.

Defined results: a null or empty text has no spans; repeated rows are each given alike; a
null doc_id stays null; ties do not arise, as spans of a kind do not overlap; an empty
table gives an empty result, and without any base span nothing is added; other columns than
doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SURE = 0.9
FIT_DOCS = 1500
ROUNDS = 12
#: Nodes and messages worked on at a time; memory beyond that is linear in a document's nodes.
_BLOCK = 1 << 16

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[0-9@][^ \t-\r]*")
_PLAIN = re.compile(r"[^0-9a-z@]+")
_OTHER = re.compile(r"[^0-9]+")

Span = tuple[int, int]


def _emails(text: str) -> list[Span]:
    spans, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            spans.append((start, found.end()))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    return spans


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[Span]]:
    """Leftmost spans of each kind that pass its test, none overlapping another of its kind."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    out["email"] = _emails(text)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() and c.isascii() for c in m.group()) <= 15:
                out["phone"].append(m.span())
    return out


def nodes(text: str) -> list[Span]:
    """Tokens with a digit or ``@``, whole."""
    spans: list[Span] = []
    free = 0
    for m in _TOKEN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] not in " \t\n\x0b\x0c\r":
            start -= 1
        free = m.end()
        spans.append((start, free))
    return spans


def features(text: str, span: Span) -> list[int]:
    """Places of the features of a node; each is 1."""
    token = text[span[0] : span[1]]
    core = token.strip(".,;:!?()[]\"'")
    digits = sum("0" <= c <= "9" for c in core)
    before = text[max(0, span[0] - 1)] if span[0] else " "
    found = [
        0,
        1 + min(digits, 20),
        22 + min(core.count("."), 4),
        27 + ("@" in core) * (1 + ("." in core.partition("@")[2])),
        30 + core.startswith("+"),
        32 + (digits == len(core)),
        34 + any(c.isalpha() for c in core),
        36 + (before == "\n"),
        38 + ("-" in core),
        40 + (core != token),
    ]
    parts = core.split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 for p in parts):
        found.append(42 + all(int(p) <= 255 for p in parts))
    return found


N_FEATURES, N_LABELS = 44, len(KINDS) + 1


def _labels(spans: list[Span], base: dict[str, list[Span]]) -> np.ndarray:
    """The label of every node by the base span that it overlaps, 0 for none."""
    labels = np.zeros(len(spans), dtype=np.int64)
    for label, kind in enumerate(KINDS, 1):
        starts, ends = [s for s, _ in base[kind]], [e for _, e in base[kind]]
        for i, (s, e) in enumerate(spans):
            if bisect_right(ends, s) < bisect_left(starts, e) and not labels[i]:
                labels[i] = label
    return labels


def _mentions(text: str, spans: list[Span], base: dict[str, list[Span]]) -> list[tuple[str, int, list[str]]]:
    """Numbers written over one or more nodes, as (all digits, first node, digits of each node), in order.

    These are the base spans of cards and phones, any run of neighbouring nodes elsewhere
    with the digits of one of them, and whole runs.
    """
    starts, ends = [s for s, _ in spans], [e for _, e in spans]
    out, taken = [], [False] * len(spans)
    for kind in ("card", "phone"):
        for s, e in base[kind]:
            low, high = bisect_right(ends, s), bisect_left(starts, e)
            parts = [_OTHER.sub("", text[max(s, starts[i]) : min(e, ends[i])]) for i in range(low, high)]
            out.append(("".join(parts), low, parts))
            taken[low:high] = [True] * (high - low)
    wanted = {digits for digits, _, _ in out}
    longest = max(map(len, wanted), default=0)
    # A token with letters or @, or of a base span, ends a run.
    pieces = ["" if t or any(c.isalpha() or c == "@" for c in text[s:e]) else _OTHER.sub("", text[s:e]) for t, (s, e) in zip(taken, spans, strict=True)]
    at = 0
    while at < len(spans):
        end = at
        while end < len(spans) and pieces[end] and (end == at or starts[end] - ends[end - 1] <= 1):
            end += 1
        known = set()
        for i in range(at, end):
            digits = ""
            for j in range(i, end):
                digits += pieces[j]
                if len(digits) > longest:
                    break
                if digits in wanted:
                    out.append((digits, i, pieces[i : j + 1]))
                    known.add((i, j + 1))
        if end - at > 1 and (at, end) not in known:
            out.append(("".join(pieces[at:end]), at, pieces[at:end]))
        at = max(end, at + 1)
    return sorted(out, key=lambda m: m[1])


def edges(text: str, spans: list[Span], base: dict[str, list[Span]]) -> tuple[np.ndarray, np.ndarray]:
    """Chain edges between neighbours apart by one space, and skip edges to the next similar node.

    Similar are tokens of at least 5 letters and digits that agree in these, and the
    places of two mentions of a number that hold the same digits, however it is spaced.
    """
    chain = [(i, i + 1) for i in range(len(spans) - 1) if spans[i + 1][0] - spans[i][1] <= 1]
    last: dict[str, int] = {}
    skips = set()
    for i, (s, e) in enumerate(spans):
        key = _PLAIN.sub("", text[s:e].lower())
        if len(key) >= 5 and key in last:
            skips.add((last[key], i))
        last[key] = i
    before: dict[str, tuple[int, list[str]]] = {}
    for digits, first, parts in _mentions(text, spans, base):
        if len(digits) < 5:
            continue
        if digits in before and before[digits][0] + len(before[digits][1]) <= first:
            start, others = before[digits]
            # Both mentions are cut at their own places; nodes are joined that share a digit.
            i = j = of_i = of_j = 0
            while i < len(others) and j < len(parts):
                end_i, end_j = of_i + len(others[i]), of_j + len(parts[j])
                if min(end_i, end_j) > max(of_i, of_j):
                    skips.add((start + i, first + j))
                if end_i <= end_j:
                    i, of_i = i + 1, end_i
                if end_j <= end_i:
                    j, of_j = j + 1, end_j
        before[digits] = first, parts
    shape = lambda x: np.array(x, dtype=np.int64).reshape(-1, 2)
    return shape(chain), shape(sorted(skips))


def _scores(found: list[list[int]], weights: np.ndarray) -> np.ndarray:
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    flat = np.fromiter((f for x in found for f in x), dtype=np.int64, count=int(sizes.sum()))
    return np.add.reduceat(weights[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(unary: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS) -> np.ndarray:
    """Node marginals by loopy belief propagation over edges, each kind with its own potentials."""
    source = np.concatenate([np.concatenate([e[:, 0], e[:, 1]]) for e, _ in pairs])
    target = np.concatenate([np.concatenate([e[:, 1], e[:, 0]]) for e, _ in pairs])
    back = np.concatenate([np.concatenate([np.arange(len(e)) + len(e), np.arange(len(e))]) + 2 * sum(len(x) for x, _ in pairs[:k]) for k, (e, _) in enumerate(pairs)])
    blocks, start = [], 0
    for e, w in pairs:
        for potential in (w, w.T):
            blocks += [(at, min(at + _BLOCK, start + len(e)), potential) for at in range(start, start + len(e), _BLOCK)]
            start += len(e)
    messages = np.zeros((len(source), unary.shape[1]))
    belief = unary.copy()
    for _ in range(rounds if len(source) else 0):
        fresh = np.empty_like(messages)
        for at, end, potential in blocks:
            ahead = belief[source[at:end]] - messages[back[at:end]]
            new = _log_sum(ahead[:, :, None] + potential, 1)
            new -= _log_sum(new, 1)[:, None]
            fresh[at:end] = 0.5 * messages[at:end] + 0.5 * new
        messages = fresh
        belief = unary.copy()
        np.add.at(belief, target, messages)
    return np.exp(belief - _log_sum(belief, 1)[:, None])


def _examples(text: str) -> Counter[bytes]:
    """A document's distinct nodes and how often each occurs: features, label, labels before and after by kind of edge."""
    spans = nodes(text)
    if not spans:
        return Counter()
    base = base_spans(text)
    labels = _labels(spans, base)
    sides = []
    for e in edges(text, spans, base):
        after, before = (np.zeros((len(spans), N_LABELS), dtype=np.int64) for _ in range(2))
        np.add.at(after, (e[:, 0], labels[e[:, 1]]), 1)
        np.add.at(before, (e[:, 1], labels[e[:, 0]]), 1)
        sides += [before, after]
    rows: Counter[bytes] = Counter()
    for at in range(0, len(spans), _BLOCK):
        part = spans[at : at + _BLOCK]
        x = np.zeros((len(part), N_FEATURES), dtype=np.uint8)
        for row, span in zip(x, part, strict=True):
            row[features(text, span)] = 1
        end = at + len(part)
        near = [np.minimum(s[at:end], 255).astype(np.uint8) for s in sides]
        rows.update(map(bytes, np.column_stack([x, labels[at:end].astype(np.uint8), *near])))
    return rows


class Model:
    """Weights of the features and of chain and skip edges, by label."""

    def __init__(self) -> None:
        self.unary = np.zeros((N_FEATURES, N_LABELS))
        self.chain = np.zeros((N_LABELS, N_LABELS))
        self.skip = np.zeros((N_LABELS, N_LABELS))

    def fit(self, texts: list[str], steps: int = 150, rate: float = 0.5) -> Model:
        """Pseudo-likelihood ascent: each node given the true labels of its neighbours."""
        rows = Counter()
        for text in texts:
            rows.update(_examples(text))
        return self.learn(rows, steps, rate)

    def learn(self, examples: dict[bytes, int], steps: int = 150, rate: float = 0.5) -> Model:
        """Ascent over distinct examples (see ``_examples``) and how often each occurs."""
        if not examples:
            return self
        rows = sorted(examples)
        table = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), -1)
        x, y = table[:, :N_FEATURES].astype(float), table[:, N_FEATURES].astype(np.int64)
        sides = [table[:, k : k + N_LABELS].astype(float) for k in range(N_FEATURES + 1, table.shape[1], N_LABELS)]
        near = [(sides[0], sides[1]), (sides[2], sides[3])]
        share = np.array([examples[r] for r in rows], dtype=float)
        share = np.concatenate([share, share]) / (2 * share.sum())
        # Every node once more without what it looks like, so that the edges learn to tell it.
        bare = np.zeros_like(x)
        bare[:, 0] = 1
        x, y = np.concatenate([x, bare]), np.concatenate([y, y])
        near = [(np.concatenate([b, b]), np.concatenate([a, a])) for b, a in near]
        truth = np.eye(N_LABELS)[y]
        weights = [self.unary, self.chain, self.skip]
        squares = [np.full_like(w, 1e-8) for w in weights]
        for _ in range(steps):
            score = x @ self.unary
            for (before, after), w in zip(near, weights[1:], strict=True):
                score = score + before @ w + after @ w.T
            p = np.exp(score - _log_sum(score, 1)[:, None])
            d = (truth - p) * share[:, None]
            grads = [x.T @ d] + [b.T @ d + (a.T @ d).T for b, a in near]
            for w, g, s in zip(weights, grads, squares, strict=True):
                g -= 1e-4 * w
                s += g * g
                w += rate * g / np.sqrt(s)
        return self

    def added(self, text: str, base: dict[str, list[Span]]) -> list[tuple[str, int, int]]:
        """Spans beyond the base ones."""
        spans = nodes(text)
        labels = _labels(spans, base)
        if labels.all():
            return []
        unary = np.concatenate(
            [_scores([features(text, s) for s in spans[at : at + _BLOCK]], self.unary) for at in range(0, len(spans), _BLOCK)]
        )
        fixed = labels > 0
        unary[fixed] = -50
        unary[fixed, labels[fixed]] = 50
        chain, skip = edges(text, spans, base)
        p = marginals(unary, [(chain, self.chain), (skip, self.skip)])
        best = p.argmax(axis=1)
        runs: list[tuple[str, int, int]] = []
        previous = -2
        for i in np.flatnonzero(~fixed & (best > 0) & (p.max(axis=1) >= SURE)):
            kind = KINDS[best[i] - 1]
            if runs and previous == i - 1 and runs[-1][0] == kind and spans[i][0] - spans[i - 1][1] <= 1:
                runs[-1] = (kind, runs[-1][1], spans[i][1])
            else:
                runs.append((kind, *spans[i]))
            previous = i
        return runs


def fitted(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """The model of at most ``fit_docs`` documents with likely personal data."""
    likely = docs.select(F.xxhash64("doc_id", "text").alias("deal"), F.col("text").cast("string").alias("text")).filter(
        F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9]|\+[0-9]|[0-9]\.[0-9]+\.[0-9]+\.|[0-9]([ -]?[0-9]){15}")
    )
    deals = [r["deal"] for r in likely.select("deal").orderBy("deal").limit(fit_docs).collect()]
    if not deals:
        return Model()
    rows = likely.filter(F.col("deal") <= max(deals)).select("text").mapInArrow(_counted, "example binary, n bigint")
    counts = rows.groupBy("example").agg(F.sum("n").alias("n")).collect()
    return Model().learn({bytes(r["example"]): r["n"] for r in counts})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: Counter[bytes] = Counter()
        for value in batch.column(0):
            rows.update(_examples(value.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.binary()), pa.array(list(rows.values()), pa.int64())], names=["example", "n"])


def _found(model: Model):
    names = [f"n_{k}" for k in KINDS]

    def digest(spans: list[tuple[str, int, int]]) -> str:
        order = {k: i for i, k in enumerate(KINDS)}
        return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {n: [] for n in names}
            hashes, all_spans, n_added = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                spans = [(k, s, e) for k in KINDS for s, e in base[k]]
                more = model.added(text, base)
                for k in KINDS:
                    counts[f"n_{k}"].append(len(base[k]))
                hashes.append(hashlib.sha256(digest(spans).encode()).hexdigest())
                all_spans.append(digest(spans + more))
                n_added.append(len(more))
            columns = [pa.array(counts[n], pa.int64()) for n in names]
            columns += [pa.array(hashes, pa.string()), pa.array(all_spans, pa.string()), pa.array(n_added, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names, "base_sha256", "spans", "n_added"])

    return of_batches


def personal_data(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """doc_id, the number of base spans by kind, their digest, and all spans as kind:start:end."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"n_{k} bigint" for k in KINDS)
    model = fitted(docs, fit_docs)
    return docs.select("doc_id", "text").mapInArrow(_found(model), f"{schema}, base_sha256 string, spans string, n_added bigint")
