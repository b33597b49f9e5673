"""Operator 11: repair of a conversation's structure by error-correcting Earley parsing.

A conversation's roles should read as an optional system turn and then pairs of user and assistant. The grammar
for that is right-linear; to its own productions come error productions with a cost: a row deleted, given another
role, or inserted. A chart has a set of items for every place between rows. An item keeps only its least (cost,
audit); since the rest of a production after its dot is one nonterminal in last place, that nonterminal's items
take over the item's place in the chart (a tail call), so sets stay small and a parse is linear in its rows.

Two audits of one item never start with each other at the same cost (they have used the same rows and differ in
inserted ones, which cost), so the least audit so far stays least whatever comes after it.

Spark sorts all rows by conversation and turn over ranges, so a conversation of any size is spread over as many
tasks as it fills. Most lie within one task and are parsed there. A longer one is cut into *segments*; each is
parsed from every nonterminal to every other, the segments' costs (no rows) meet to choose the least way through
them, and the repaired text of each is read once more, in order, for the digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import cut, partitions

#: Rows and bytes of text that a segment holds at most (a single longer row is a segment by itself).
ROWS, BYTES = 256, 4 << 20

BLANK, DUPLICATE, TRUNCATED, SOUND = "B", "D", "T", "."
TRUNCATED_COST = 5
NAMES = {"s": "system", "u": "user", "a": "assistant"}


# -- the grammar -----------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Production:
    """``left`` becomes a row with initial ``role``, and then ``right``. ``edit`` says what is done for that, ``cost`` what it costs."""

    left: str
    right: str
    role: str | None
    edit: str
    cost: int


OPEN, LED, ASKED, ANSWERED = "open", "led", "asked", "answered"
#: Nonterminals: nothing yet, a system turn, a user's turn, an assistant's turn has been read.
STATES = (OPEN, LED, ASKED, ANSWERED)
#: Those that may also become nothing: the end of a conversation.
ENDS = (OPEN, ANSWERED)
_STEPS = [(OPEN, LED, "s"), (OPEN, ASKED, "u"), (LED, ASKED, "u"), (ASKED, ANSWERED, "a"), (ANSWERED, ASKED, "u")]
GRAMMAR = {
    state: [Production(a, b, role, edit, cost) for a, b, role in _STEPS if a == state for edit, cost in (("K", 0), ("R", 1), ("I", 5)) if edit == "K" or role != "s"] + [Production(state, state, None, "D", 2)]
    for state in STATES
}


def parse(tokens: str, start: str = OPEN, closing: bool = True) -> dict[str, tuple[int, str]]:
    """The least (cost, audit) of reading all rows from ``start``, for every nonterminal that is left then.

    ``tokens`` has two characters for each row: the role's initial and the fault. With ``closing`` rows may also be
    inserted after the last one.
    """
    chart: dict[str, tuple[int, str]] = {start: (0, "")}
    count = len(tokens) // 2
    for at in range(count + 1):
        agenda = [(cost, audit, left) for left, (cost, audit) in chart.items()]
        agenda.sort()
        done: dict[str, tuple[int, str]] = {}
        after: dict[str, tuple[int, str]] = {}
        role, fault = (tokens[2 * at], tokens[2 * at + 1]) if at < count else ("", "")
        while agenda:
            cost, audit, left = heappop(agenda)
            if left in done:  # an item that came here at less
                continue
            done[left] = (cost, audit)
            for p in GRAMMAR[left]:
                if p.edit == "I":  # predicted here, without a row
                    if (at < count or closing) and p.right not in done:
                        heappush(agenda, (cost + p.cost, audit + "I", p.right))
                    continue
                if at == count or (p.edit == "K" and p.role != role) or (p.edit != "D" and fault in (BLANK, DUPLICATE)):
                    continue
                item = (cost + p.cost + (TRUNCATED_COST if fault == TRUNCATED and p.edit != "D" else 0), audit + p.edit)
                if p.right not in after or item < after[p.right]:
                    after[p.right] = item
        chart = after if at < count else done
    return chart


@lru_cache(maxsize=50_000)
def repair(tokens: str) -> tuple[int, str]:
    """The least (cost, audit) of a whole conversation: the completed chart's best item."""
    chart = parse(tokens)
    return min(chart[end] for end in ENDS if end in chart)


def replay(audit: str, tokens: str, start: str = OPEN) -> Iterator[tuple[int | None, str | None]]:
    """What an audit leaves: (row, None) for one that is kept, (row, role) for one that is given a role, (None, role) for an inserted one."""
    at, state = 0, start
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        role = tokens[2 * at] if edit == "K" else "a" if state == ASKED else "u"
        yield (None if edit == "I" else at, None if edit == "K" else NAMES[role])
        state = next(p.right for p in GRAMMAR[state] if p.edit == edit and p.role == role)
        at += edit != "I"


# -- rows ------------------------------------------------------------------------------------------------------------
def damage(conversations: DataFrame, conv: str, turn: str) -> DataFrame:
    """The rows (conv, turn, role, text) with faults made by a digest of their name; a dropped row stays with null for ``text``."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one(conv), F.lit(":"), one(turn)).cast("binary")) % 20
    rows = conversations.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text"), kind.alias("kind"))
    k = F.col("kind")
    text = F.when(k == 0, F.lit(None)).when(k == 1, F.lit("")).when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    made = rows.select("conv", "turn", F.when(k == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(k == 3, 2).otherwise(1).alias("copies"))
    return made.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")


_WHITE = "\x20\t\n\x0b\x0c\r"


def fault(text: str, seen: bool) -> str:
    """A row's first fault; ``seen``: an earlier row has its role and text."""
    held = text.rstrip(_WHITE)
    if not held:
        return BLANK
    return DUPLICATE if seen else SOUND if held[-1] in ".!?" else TRUNCATED


def illegal(initials: str) -> int:
    """Neighbours that don't follow each other."""
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _initial(role: str) -> str:
    return role[:1] or "\0"


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_DONE_DDL = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_OUT_DDL = f"conv long, {_DONE_DDL}, segment long, place int, turn long, role string, text string"


def _arrow(ddl: str) -> pa.Schema:
    """The Arrow form of a plain schema."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(","))])


def _lines(audit: str, tokens: str, roles: list[str], texts: list[str], start: str = OPEN) -> list[str]:
    """The repaired rows as ``role:text``."""
    return [f"{role or roles[row]}:{'' if row is None else texts[row]}" for row, role in replay(audit, tokens, start)]


def _whole(rows: list[tuple]) -> dict:
    """The results of a conversation that lies before us with all its rows (conv, turn, role, text)."""
    kept = [r for r in rows if r[3] is not None]
    faults, seen = [], set()
    for _, _, role, text in kept:
        faults.append(fault(text, (role, text) in seen))
        seen.add((role, text))
    initials = "".join(_initial(r[2]) for r in kept)
    tokens = "".join(a + b for a, b in zip(initials, faults))
    cost, audit = repair(tokens)
    turns = {r[1] for r in kept if r[1] is not None}
    repaired = "\n".join(_lines(audit, tokens, [r[2] for r in kept], [r[3] for r in kept]))
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED), "illegal": illegal(initials),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(repaired.encode()).hexdigest(),
    }


def _sorted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finished conversations as results, and the rows of those that other tasks may hold too, or that fill more than a segment, with their segment."""
    schema = _arrow(_OUT_DDL)
    empty = dict.fromkeys(schema.names)
    held: list[tuple] = []
    state = {"segments": 0, "size": 0, "open": True}  # the first conversation of a task may have begun in another one
    partition = TaskContext.get().partitionId()
    out: list[dict] = []

    def close(goes_on: bool) -> None:
        """The rows held become a result, or a segment."""
        if held and (state["open"] or goes_on):
            segment = partition << 32 | state["segments"]
            state["segments"] += 1
            out.extend(empty | {"conv": c, "segment": segment, "place": i, "turn": t, "role": r, "text": x} for i, (c, t, r, x) in enumerate(held))
        elif held:
            out.append(empty | {"conv": held[0][0]} | _whole(held))
        state["open"], state["size"] = goes_on, 0
        held.clear()

    for batch in batches:
        columns = [batch.column(i) for i in range(4)]
        for start in range(0, batch.num_rows, 512):
            for row in zip(*(c.slice(start, 512).to_pylist() for c in columns)):
                size = len(row[3] or "")
                if held and row[0] != held[0][0]:
                    close(False)
                elif len(held) >= ROWS or (held and state["size"] + size > BYTES):
                    close(True)
                held.append(row)
                state["size"] += size
                if len(out) >= 512:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out.clear()
    close(True)  # the last one may go on in another task
    yield pa.RecordBatch.from_pylist(out, schema=schema)


# -- conversations of several segments -------------------------------------------------------------------------------
_SEGMENT_DDL = "conv string, segment long, costs array<long>, ranks array<int>, audits array<string>, blank long, duplicate long, truncated long, illegal long, turns long, first_turn string, last_turn string, first string, last string"


def _tokens(rows: pd.DataFrame) -> str:
    return "".join(_initial(r) + fault(t, bool(s)) for r, t, s in zip(rows["role"], rows["text"], rows["seen"]))


def _ordered(rows: pd.DataFrame) -> pd.DataFrame:
    return rows[rows["text"].notna()].sort_values("place", kind="stable")


def _segment(rows: pd.DataFrame) -> pd.DataFrame:
    """One segment: costs and audits from every nonterminal to every other, and what its neighbours need to know."""
    kept = _ordered(rows)
    tokens = _tokens(kept)
    costs, ranks, audits = [], [], []
    for start in STATES:
        chart = parse(tokens, start, closing=False)
        order = sorted(audit for _, audit in chart.values())
        for end in STATES:
            cost, audit = chart.get(end, (-1, ""))
            costs.append(cost)
            ranks.append(order.index(audit) if cost >= 0 else -1)  # among the audits of one start: they use the same rows, so none goes on from another
            audits.append(audit)
    turns = [int(t) for t in kept["turn"] if t is not None]
    initials, faults = tokens[::2], tokens[1::2]
    out = {
        "conv": rows["conv"].iloc[0], "segment": rows["segment"].iloc[0], "costs": costs, "ranks": ranks, "audits": audits,
        "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED), "illegal": illegal(initials),
        "turns": len(set(turns)), "first_turn": str(min(turns)) if turns else None, "last_turn": str(max(turns)) if turns else None, "first": initials[:1], "last": initials[-1:],
    }
    return pd.DataFrame([out], dtype=object)


def _ways(segments: Iterable[tuple[list[int], list[int]]]) -> tuple[list[int], int, str]:
    """The nonterminal at which each segment starts on the least way, the nonterminal after the last one, and what is inserted there."""
    tails = {state: min((item[0], item[1], end) for end, item in parse("", state).items() if end in ENDS) for state in STATES}
    togo = [[tails[s][0] for s in STATES]]
    segments = list(segments)
    size, none = len(STATES), 1 << 62
    for costs, _ in reversed(segments):
        togo.append([min((costs[s * size + e] + togo[-1][e] if costs[s * size + e] >= 0 else none) for e in range(size)) for s in range(size)])
    togo.reverse()
    starts, at = [], 0
    for i, (costs, ranks) in enumerate(segments):
        starts.append(at)
        best = [(ranks[at * size + e], e) for e in range(size) if costs[at * size + e] >= 0 and costs[at * size + e] + togo[i + 1][e] == togo[i][at]]
        at = min(best)[1]
    return starts, at, tails[STATES[at]][1]


def _total(rows: pd.DataFrame) -> pd.DataFrame:
    """All segments of one conversation (costs and counts, no rows): the way through them, and the conversation's counts on its first."""
    rows = rows.sort_values("segment", kind="stable").reset_index(drop=True)
    starts, last, tail = _ways(zip(rows["costs"].map(list), rows["ranks"].map(list)))
    ends = [*starts[1:], last]
    size = len(STATES)
    cost = sum(int(c[s * size + e]) for c, s, e in zip(rows["costs"], starts, ends)) + 5 * len(tail)
    counts = {c: int(rows[c].sum()) for c in _COUNTS}
    edges = [(a, b) for a, b in zip(rows["first"], rows["last"]) if a]
    counts["illegal"] += sum(illegal(x[1] + y[0]) for x, y in zip(edges, edges[1:]))
    held = rows[rows["turns"] > 0]
    turns = int(held["turns"].sum()) - sum(a == b for a, b in zip(held["last_turn"], held["first_turn"].iloc[1:]))
    gaps = int(held["last_turn"].iloc[-1]) - int(held["first_turn"].iloc[0]) + 1 - turns if len(held) else 0
    out = rows[["conv", "segment"]].copy()
    out["start"], out["end"] = starts, ends
    out["tail"] = [""] * (len(out) - 1) + [tail]
    for name, value in (counts | {"gaps": gaps, "cost": cost}).items():
        out[name] = value
    return out


def _piece(rows: pd.DataFrame, ways: pd.DataFrame) -> pd.DataFrame:
    """A segment's audit and repaired lines on the way that was chosen."""
    way = ways.iloc[0]
    kept = _ordered(rows)
    audit, start = str(way["audit"]) + str(way["tail"]), STATES[int(way["start"])]
    lines = _lines(audit, _tokens(kept), list(kept["role"]), list(kept["text"]), start)
    return pd.DataFrame({"conv": [way["conv"]], "segment": [way["segment"]], "audit": [audit], "lines": [len(lines)], "text": ["\n".join(lines)]})


_DIGEST_DDL = "conv string, audit string, repaired_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by conversation and segment become one audit and one digest for each conversation; a piece at a time is held."""
    conv, digest, audit, begun, any_lines = None, None, [], False, False
    schema = _arrow(_DIGEST_DDL)

    def result() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"conv": conv, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema=schema)

    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in ("conv", "audit", "lines", "text")}
            if not begun or row["conv"] != conv:
                if begun:
                    yield result()
                conv, digest, audit, begun, any_lines = row["conv"], hashlib.sha256(), [], True, False
            audit.append(row["audit"])
            if row["lines"]:
                digest.update((("\n" if any_lines else "") + row["text"]).encode())
                any_lines = True
    if begun:
        yield result()


def _long(rows: DataFrame) -> DataFrame:
    """The results of conversations whose rows come in segments."""
    rows = rows.select(F.col("conv").cast("string").alias("conv"), "segment", "place", F.col("turn").cast("string").alias("turn"), "role", "text")
    name = F.md5(F.concat_ws("\x01", F.length("role").cast("string"), "role", "text").cast("binary"))
    live = rows.where("text is not null").withColumn("name", name)
    in_segment = live.groupBy("conv", "name", "segment").agg(F.min("place").alias("place"))  # a text that a segment holds many times is one row
    firsts = in_segment.groupBy("conv", "name").agg(F.min(F.struct("segment", "place")).alias("f"))
    first = firsts.select("f.segment", "f.place", F.lit(False).alias("new"))
    marked = rows.join(first, ["segment", "place"], "left").withColumn("seen", F.coalesce("new", F.lit(True))).drop("new")
    marked = cut(marked)
    segments = cut(marked.groupBy("segment").applyInPandas(_segment, _SEGMENT_DDL))
    totals = "conv string, segment long, start int, end int, tail string, blank long, duplicate long, truncated long, illegal long, gaps long, cost long"
    ways = cut(segments.drop("audits").groupBy("conv").applyInPandas(_total, totals))
    chosen = ways.join(segments.select("segment", "audits"), "segment").select("conv", "segment", "start", "tail", F.get("audits", F.col("start") * len(STATES) + F.col("end")).alias("audit"))
    pieces = cut(marked.groupBy("segment").cogroup(chosen.groupBy("segment")).applyInPandas(_piece, "conv string, segment long, audit string, lines long, text string"))
    found = pieces.repartition(partitions(rows.sparkSession), "conv").sortWithinPartitions("conv", "segment").mapInArrow(_digests, _DIGEST_DDL)
    one = ways.groupBy("conv").agg(*[F.max(c).alias(c) for c in ("gaps", *_COUNTS, "cost")])
    joined = one.join(found.withColumnRenamed("conv", "_conv"), F.col("conv").eqNullSafe(F.col("_conv")))
    return joined.select(F.col("conv").cast("long").alias("conv"), "gaps", *_COUNTS, "cost", "audit", "repaired_sha256")


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Structure and cheapest repair of every conversation: rows (conv, turn, role, text), a null text for a row that isn't there.

    Rows are taken by turn (nulls first); rows of one turn by role and a digest of their text, so rows that are alike lie
    side by side.
    A role counts by its first character; one without characters fits nowhere. Returns per conv: gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256. A conversation without rows has zeros, an empty
    audit and the empty text's digest. Rows with a null conv are one conversation. An empty table gives an empty
    result.
    """
    order: list[Column] = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc_nulls_first("role")]
    bounds = [*order, F.asc(F.xxhash64("text"))]
    dealt = rows.select("conv", "turn", "role", "text").repartitionByRange(partitions(rows.sparkSession), *bounds).sortWithinPartitions(*bounds, F.asc_nulls_first("text"))
    found = cut(dealt.mapInArrow(_sorted_rows, _OUT_DDL))
    finished = found.where("segment is null").select("conv", "gaps", *_COUNTS, "cost", "audit", "repaired_sha256")
    return finished.union(_long(found.where("segment is not null")))


def repair_damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Damages every row by the law of ``damage`` and repairs every conversation: one row for each ``conv`` of the table.

    Null roles and texts count as one space, and so do null conv and turn in the digest that damages; other columns
    are ignored. See ``repair_conversations`` for repeated rows, ties and empty tables.
    """
    return repair_conversations(damage(conversations, conv, turn)).withColumnRenamed("conv", conv)
