"""Repair of conversations: the cheapest edits that give a legal order of roles.

Legal initials of roles are ``(s?(ua)+)?``. Edits: Keep (free), Rerole to user or assistant
(2), Delete (3, required for blank and duplicate messages), Insert an empty user or assistant
message (2); a truncated message that stays adds 1. Of the cheapest edits those whose initials
come first in ASCII are taken.

Method: Hirschberg. Four states say what stands last (nothing, system, user, assistant). A
vector of costs runs forward to the middle of a conversation and one backward from its end;
the cheapest state in which they meet cuts the task in two, so only vectors are kept. Inserts
count with the message after them. No string of edits up to a message is then the beginning
of another, so one rank per state, carried with the costs, tells which crossing has the least
string of edits.

On Spark: messages are dealt out by ranges of (conversation, turn, role, digest of the text),
so that a conversation of any length is spread over tasks. Of a conversation that reaches over
several ranges each gives a 4 x 4 table of costs and ranks; those tables, as many as ranges,
choose the states at the borders, and every range is then solved by itself. Texts take no part
in that; they join the edits at the end. Only the digest of a conversation runs through its
messages in order, as a stream.

Null role or text: one space. Null conv_id: a conversation of its own. Messages of one turn
follow by role, then by digest of the text; null turns come first. Equal rows are copies of
one message: the first may stay, the others are duplicates. A role whose initial is none of
s, u, a, or that is empty, cannot be kept. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

SPACE = " \t\n\x0b\x0c\r"
KEYS = ["conv_id", "turn", "role", "digest"]
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_STATES = range(4)
_FAR = 1 << 60
_END = 12  # the code that stands behind the last message
#: From a state, the edits and states that inserts alone lead to; more of them never pay.
_INSERTS = {s: [("", s), ("I", ASSISTANT if s == USER else USER)] + [("II", ASSISTANT)] * (s != USER) for s in _STATES}

Step = list[tuple[int, int, int, str]]


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by a checksum of their key."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fate = F.pmod(F.crc32(F.encode(key, "utf-8")), F.lit(20))
    text = F.coalesce("text", space)
    return rows.select(
        "conv_id",
        "turn",
        F.when(fate == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _steps_of(code: int) -> Step:
    """(from, to, cost, edits) for a message: initial s, u, a or other, + 4 if truncated, + 8 if it must go."""
    if code == _END:
        return [(NOTHING, NOTHING, 0, ""), (SYSTEM, NOTHING, 4, "II"), (USER, NOTHING, 2, "I"), (ASSISTANT, NOTHING, 0, "")]
    initial, extra = code % 4, code // 4 % 2
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start in _STATES:
        for inserts, at in _INSERTS[start]:
            found = [(at, 3, "D")]
            if code < 8:
                turned = ASSISTANT if at == USER else USER
                found.append((turned, 2 + extra, "R"))
                kept = {0: SYSTEM if at == NOTHING else None, 1: turned if at != USER else None, 2: turned if at == USER else None}.get(initial)
                if kept is not None:
                    found.append((kept, extra, "K"))
            for to, cost, edit in found:
                new = (cost + 2 * len(inserts), inserts + edit)
                best[start, to] = min(best.get((start, to), new), new)
    return [(start, to, cost, edits) for (start, to), (cost, edits) in best.items()]


# A message that must go is so whatever its initial and end, so code 8 stands for all of them.
_STEPS = [_steps_of(code) for code in range(9)] + [[]] * 3 + [_steps_of(_END)]
_EDITS = [{(start, to): edits for start, to, _, edits in steps} for steps in _STEPS]


def forward(codes: Sequence[int], low: int, high: int, start: int) -> tuple[list[int], list[int]]:
    """Per state the least cost from ``start`` over these messages, and the rank of its least edits."""
    costs, ranks = [_FAR] * 4, [0] * 4
    costs[start] = 0
    for k in range(low, high):
        best: list[tuple | None] = [None] * 4
        for a, b, cost, edits in _STEPS[codes[k]]:
            if costs[a] < _FAR:
                new = (costs[a] + cost, ranks[a], edits)
                if best[b] is None or new < best[b]:
                    best[b] = new
        costs = [_FAR if x is None else x[0] for x in best]
        order = sorted((x[1], x[2], s) for s, x in enumerate(best) if x is not None)
        for rank, (_, _, s) in enumerate(order):
            ranks[s] = rank
    return costs, ranks


def backward(codes: Sequence[int], low: int, high: int, end: int) -> list[int]:
    """Per state the least cost from it over these messages to ``end``."""
    costs = [_FAR] * 4
    costs[end] = 0
    for k in range(high - 1, low - 1, -1):
        best = [_FAR] * 4
        for a, b, cost, _ in _STEPS[codes[k]]:
            if costs[b] + cost < best[a]:
                best[a] = costs[b] + cost
        costs = best
    return costs


def edits_between(codes: Sequence[int], low: int, high: int, start: int, end: int, out: list[str]) -> None:
    """Appends the edits of each message of the least cheapest way between two states."""
    if high - low == 1:
        out.append(_EDITS[codes[low]][start, end])
    elif high > low:
        middle = (low + high) // 2
        costs, ranks = forward(codes, low, middle, start)
        rest = backward(codes, middle, high, end)
        crossing = min(_STATES, key=lambda s: (costs[s] + rest[s], ranks[s]))
        edits_between(codes, low, middle, start, crossing, out)
        edits_between(codes, middle, high, crossing, end, out)


def made_roles(edits: str, state: int, initial: int) -> tuple[str, int]:
    """The initials of the roles that inserts and reroles give, and the state after the edits."""
    made = ""
    for edit in edits:
        if edit == "K":
            state = (SYSTEM, USER, ASSISTANT)[initial]
        elif edit != "D":
            state = ASSISTANT if state == USER else USER
            made += "ua"[state == ASSISTANT]
    return made, state


def _runs(ids: list) -> Iterator[tuple[int, int]]:
    low = 0
    for k in range(1, len(ids) + 1):
        if k == len(ids) or ids[k] != ids[low]:
            yield low, k
            low = k


def _tables(conv_type: pa.DataType) -> Callable[[pa.Table], pa.Table]:
    """For each conversation of a range: costs and ranks from every state to every state."""

    def of_range(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        ids, codes, part = rows["conv_id"].to_pylist(), rows["code"].to_pylist(), rows["part"][0].as_py()
        out: list[list] = [[], [], [], []]
        for low, high in _runs(ids):
            vectors = [forward(codes, low, high, s) for s in _STATES]
            for column, value in zip(out, (ids[low], part, [c for v in vectors for c in v[0]], [r for v in vectors for r in v[1]]), strict=True):
                column.append(value)
        types = (conv_type, pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        return pa.table([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["conv_id", "part", "costs", "ranks"])

    return of_range


def _borders(conv_type: pa.DataType) -> Callable[[pa.Table], pa.Table]:
    """The states in which a conversation that reaches over several ranges crosses their borders."""

    def of_conversation(pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by("part")
        costs, ranks, from_state = [0, _FAR, _FAR, _FAR], [0] * 4, []
        for table, orders in zip(pieces["costs"].to_pylist(), pieces["ranks"].to_pylist(), strict=True):
            best = [min((costs[a] + table[4 * a + b], ranks[a], orders[4 * a + b], a) for a in _STATES) for b in _STATES]
            from_state.append([x[3] for x in best])
            order = sorted((x[1], x[2], b) for b, x in enumerate(best) if x[0] < _FAR)
            costs, ranks = [min(x[0], _FAR) for x in best], [0] * 4
            for rank, (_, _, b) in enumerate(order):
                ranks[b] = rank
        last = {a: cost for a, _, cost, _ in _STEPS[_END]}
        state = min(_STATES, key=lambda s: (costs[s] + last[s], ranks[s]))
        starts, ends = [], []
        for came in reversed(from_state):
            ends.append(state)
            state = came[state]
            starts.append(state)
        n = len(pieces)
        columns = [pieces["conv_id"], pieces["part"], pa.array(starts[::-1], pa.int32()), pa.array(ends[::-1], pa.int32()), pa.array([k == n - 1 for k in range(n)])]
        return pa.table(columns, names=["b_conv", "b_part", "start", "end", "last"])

    return of_conversation


def _solved(rows: pa.Table) -> pa.Table:
    """The edits of each message of a range; ``tail`` holds the roles put in behind the last one."""
    rows = rows.sort_by("place")
    ids, codes = rows["conv_id"].to_pylist(), rows["code"].to_pylist()
    starts, ends, last = (rows[n].to_pylist() for n in ("start", "end", "last"))
    edits, made, tails = [], [], []
    for low, high in _runs(ids):
        own = codes[low:high]
        whole = starts[low] is None
        state = NOTHING if whole else starts[low]
        found: list[str] = []
        if whole:
            edits_between([*own, _END], 0, len(own) + 1, state, NOTHING, found)
        else:
            edits_between(own, 0, len(own), state, ends[low], found)
            found.append(_EDITS[_END][ends[low], NOTHING] if last[low] else "")
        for code, edit in zip(own, found, strict=False):
            roles, state = made_roles(edit, state, code % 4)
            made.append(roles)
        edits += found[:-1]
        tails += [""] * (len(own) - 1) + [made_roles(found[-1], state, 3)[0]]
    names = ["conv_id", "turn", "role", "digest", "place", "copies", "fault"]
    return pa.table([*(rows[n] for n in names), pa.array(edits, pa.string()), pa.array(made, pa.string()), pa.array(tails, pa.string())], names=[*names, "edits", "made", "tail"])


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[f"_{name}"])
    return condition


def _digest() -> Column:
    return F.md5(F.encode("text", "utf-8")).alias("digest")


def edits(messages: DataFrame) -> DataFrame:
    """Per different message (conv_id, turn, role, digest, place, copies, fault, edits, made, tail).

    ``place`` grows along a conversation. ``edits`` are the initials of the edits up to the
    first copy, all others being deleted, and ``made`` the initials of the roles they make.
    """
    session = messages.sparkSession
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    cut_short = ~F.substring(bare, -1, 1).isin(".", "!", "?")
    narrow = (
        messages.filter("copies > 0")
        .select("conv_id", "turn", "role", _digest(), (bare == "").alias("is_blank"), cut_short.alias("is_cut"), "copies")
        .groupBy(*KEYS, "is_blank", "is_cut")
        .agg(F.sum("copies").alias("copies"))
    )
    # Written once, so that places stay when a later task runs again.
    placed = stored(
        narrow.repartitionByRange(*KEYS).sortWithinPartitions(*KEYS)
        .withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()),
        "turns",
    )
    said = ["conv_id", "role", "digest"]
    firsts = placed.groupBy(*[F.col(n).alias(f"_{n}") for n in said]).agg(F.min("place").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    repeated = F.coalesce(F.col("place") > F.col("_first"), F.lit(False))
    initial = F.substring("role", 1, 1)
    fault = F.when(F.col("is_blank"), BLANK).when(repeated, DUPLICATE).when(F.col("is_cut"), TRUNCATED).otherwise("")
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = F.when(F.col("fault").isin(BLANK, DUPLICATE), 8).otherwise(kind + F.when(F.col("fault") == TRUNCATED, 4).otherwise(0))
    flagged = stored(
        placed.join(firsts, _same(placed, firsts, said), "left")
        .select(*KEYS, "part", "place", "copies", fault.alias("fault")).withColumn("code", code),
        "faults",
    )
    # A border between two ranges cuts one conversation, so there are fewer of these than ranges.
    cut = placed.groupBy(F.col("conv_id").alias("_conv_id")).agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a < b")
    conv_type = messages.schema["conv_id"].dataType
    name, arrow = conv_type.simpleString(), pa.int64() if conv_type.simpleString() == "bigint" else None
    arrow = arrow or session.createDataFrame([], f"x {name}").toArrow().schema[0].type
    pieces = (
        flagged.join(F.broadcast(cut.select("_conv_id")), _same(flagged, cut, ["conv_id"]), "left_semi")
        .select("conv_id", "part", "place", "code").groupBy("part")
        .applyInArrow(_tables(arrow), f"conv_id {name}, part int, costs array<bigint>, ranks array<int>")
    )
    borders = stored(
        pieces.groupBy("conv_id").applyInArrow(_borders(arrow), f"b_conv {name}, b_part int, start int, end int, last boolean"), "borders"
    )
    here = flagged["conv_id"].eqNullSafe(borders["b_conv"]) & (flagged["part"] == borders["b_part"])
    types = dict(flagged.dtypes)
    return (
        flagged.join(F.broadcast(borders), here, "left").drop("b_conv", "b_part").groupBy("part")
        .applyInArrow(_solved, ", ".join(f"{n} {types[n]}" for n in (*KEYS, "place", "copies", "fault")) + ", edits string, made string, tail string")
    )


def steps(messages: DataFrame) -> DataFrame:
    """The edits with the text of each message that stays."""
    texts = (
        messages.filter("copies > 0").select("conv_id", "turn", "role", _digest(), "text")
        .groupBy(*[F.col(n).alias(f"_{n}") for n in KEYS]).agg(F.first("text").alias("_text"))
    )
    found = edits(messages)
    text = F.when(F.endswith(F.col("edits"), F.lit("D")), F.lit(None)).otherwise(F.col("_text"))
    return found.join(texts, _same(found, texts, KEYS), "left").select(*found.columns, text.alias("text"))


def repaired(messages: DataFrame) -> DataFrame:
    """(conv_id, place, step, edit, role, text) of the repaired conversations, in order of place and step."""
    full = F.when(F.col("c") == "u", "user").otherwise("assistant")
    found = steps(messages)
    made, kept = F.col("made"), F.endswith(F.col("edits"), F.lit("K"))
    rerole = F.endswith(F.col("edits"), F.lit("R"))
    before = F.when(rerole, F.substring(made, F.lit(1), F.length(made) - 1)).otherwise(made)

    def put_in(roles: Column, start: Column) -> Column:
        letters = F.filter(F.split(roles, ""), lambda c: c != "")
        return F.transform(letters, lambda c, i: F.struct((start + i).alias("step"), F.lit("I").alias("edit"), F.when(c == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")))

    n = F.length("edits")
    role = F.when(kept, F.col("role")).otherwise(F.when(F.substring(made, -1, 1) == "u", "user").otherwise("assistant"))
    own = F.struct((n - 1).alias("step"), F.substring("edits", -1, 1).alias("edit"), role.alias("role"), F.col("text").alias("text"))
    stays = F.when(kept | rerole, F.array(own)).otherwise(F.array().cast("array<struct<step:int,edit:string,role:string,text:string>>"))
    rows = F.concat(put_in(before, F.lit(0)), stays, put_in(F.col("tail"), n))
    return found.select("conv_id", "place", F.explode(rows).alias("_row")).select("conv_id", "place", "_row.*")


def _reported(conv_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row per conversation from its steps in order; keeps a running hash, not the messages."""
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        now: dict | None = None

        def put(role: str, text: str) -> None:
            now["hash"].update(f"{chr(10) if now['messages'] else ''}{role}:{text}".encode())
            now["messages"] += 1

        def closed() -> None:
            if now is not None:
                if now["low"] is not None:
                    now["gaps"] = now["turn"] - now["low"] + 1 - now["turns"]
                now["audit"] = "".join(now["audit"])
                now["hash"] = now["hash"].hexdigest()
                done.append(now)

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or now["conv_id"] != row["conv_id"]:
                    closed()
                    now = dict.fromkeys(longs, 0) | {"conv_id": row["conv_id"], "audit": [], "hash": hashlib.sha256(), "messages": 0, "low": None, "turn": None, "turns": 0, "initial": None}
                if row["place"] is None:
                    continue
                turn, copies, fault, initial = row["turn"], row["copies"], row["fault"], row["role"][:1]
                if turn is not None:
                    now["low"] = turn if now["low"] is None else now["low"]
                    now["turns"] += turn != now["turn"]
                    now["turn"] = turn
                if fault:
                    now[fault] += 1
                now[BLANK if fault == BLANK else DUPLICATE] += copies - 1
                if now["initial"] is not None:
                    now["illegal"] += now["initial"] + initial not in ("su", "ua", "au")
                now["illegal"] += copies - 1
                now["initial"] = initial
                own, made = row["edits"], list(row["made"])
                for edit in own[:-1]:
                    put({"u": "user", "a": "assistant"}[made.pop(0)], "")
                if own[-1] != "D":
                    put(row["role"] if own[-1] == "K" else {"u": "user", "a": "assistant"}[made.pop(0)], row["text"])
                    now["cost"] += 2 * (own[-1] == "R") + (fault == TRUNCATED)
                for role in row["tail"]:
                    put({"u": "user", "a": "assistant"}[role], "")
                inserts = len(own) - 1 + len(row["tail"])
                now["cost"] += 2 * inserts + 3 * (copies - 1 + (own[-1] == "D"))
                now["audit"].append(own + "D" * (copies - 1) + "I" * len(row["tail"]))
            yield _as_batch(done, conv_type, longs)
            done = []
        closed()
        yield _as_batch(done, conv_type, longs)

    return of_batches


def _as_batch(done: list[dict], conv_type: pa.DataType, longs: list[str]) -> pa.RecordBatch:
    columns = [pa.array([d["conv_id"] for d in done], conv_type)] + [pa.array([d[n] for d in done], pa.int64()) for n in longs]
    columns += [pa.array([d[n] for d in done], pa.string()) for n in ("audit", "hash")]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", *longs, "audit", "repaired_sha256"])


def reports(messages: DataFrame) -> DataFrame:
    """One row per conversation, also of those without messages: faults, cost, edits and a digest."""
    found = steps(messages)
    known = messages.select("conv_id").distinct()
    rows = found.drop("digest").unionByName(known, allowMissingColumns=True)
    kind = messages.schema["conv_id"].dataType.simpleString()
    arrow = messages.sparkSession.createDataFrame([], f"x {kind}").toArrow().schema[0].type
    longs = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
    return (
        rows.repartition("conv_id").sortWithinPartitions("conv_id", "place")
        .mapInArrow(_reported(arrow), f"conv_id {kind}, {longs}, audit string, repaired_sha256 string")
    )
