"""Repair of conversation structure by generalised LR parsing with weighted edits.

A conversation is read as the word of its role initials and has to become one of

    D -> empty | L a        L -> H u | L a u        H -> empty | s

(an optional system turn, then pairs of user and assistant). The parser keeps a
graph-structured stack: a node is a state and the node below it, nodes are
shared, and the front holds every stack that some sequence of edits leads to,
each with its least (cost, audit). Keep, rerole and insert push a symbol, delete
pushes none; equal stack tops are merged by minimum. Here equal tops have equal
futures, and two audits of one cost never differ by trailing inserts only, so
the minimum over prefixes is the minimum over whole repairs.

Conversations may be longer than a task should hold. Rows are range-sorted, so a
long one lies across many partitions; it is read in segments of ``SEGMENT``
rows. A segment that may continue another one gives the least (cost, audit) from
each of the four possible stacks to each of them; folding these tables along the
conversation settles the edits of every segment. Conversations within one
partition and segment are settled where they are.
"""

from __future__ import annotations

import hashlib
from functools import cache
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import pinned, text_batches

SEGMENT = 4096
DELETE, RETYPE, INSERT, CUT = 3, 2, 2, 1
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
_BLANKS = " \t\n\x0b\x0c\r"
_ROLES = {"u": "user", "a": "assistant"}

# The automaton: shifts, reductions by state (head, symbols), and the states after a head.
_SHIFT = {(0, "s"): 1, (2, "u"): 3, (4, "a"): 5, (5, "u"): 6}
_REDUCE = {1: ("H", 1), 3: ("L", 2), 6: ("L", 3)}
_GOTO = {(0, "H"): 2, (0, "L"): 4}

Node = tuple  # (state, node below)
EMPTY: Node = (0, None)
#: The stacks between two turns: nothing read, after s, after u, after a.
STACKS = (EMPTY, (2, EMPTY), (4, EMPTY), (5, (4, EMPTY)))
_PLACE = {node: i for i, node in enumerate(STACKS)}
_ENDS = (0, 3)


@cache
def push(node: Node, symbol: str) -> Node | None:
    """The stack after ``symbol`` and the reductions it completes; None where the grammar has no place for it."""
    if node == EMPTY and symbol == "u":
        node = (_GOTO[0, "H"], node)  # an empty H
    to = _SHIFT.get((node[0], symbol))
    if to is None:
        return None
    node = (to, node)
    while node[0] in _REDUCE:
        head, size = _REDUCE[node[0]]
        for _ in range(size):
            node = node[1]
        node = (_GOTO[node[0], head], node)
    return node


def _merge(front: dict, node: Node | None, cost: int, audit: str) -> bool:
    if node is None or (node in front and front[node] <= (cost, audit)):
        return False
    front[node] = (cost, audit)
    return True


def _inserts(front: dict) -> dict:
    moved = True
    while moved:
        moved = False
        for node, (cost, audit) in list(front.items()):
            for symbol in "ua":
                moved |= _merge(front, push(node, symbol), cost + INSERT, audit + "I")
    return front


def step(front: dict, initial: str, fault: int) -> dict:
    """The front after one more row and any inserts behind it."""
    out: dict = {}
    cut = CUT if fault == TRUNCATED else 0
    for node, (cost, audit) in front.items():
        _merge(out, node, cost + DELETE, audit + "D")
        if fault not in (BLANK, DUPLICATE):
            _merge(out, push(node, initial), cost + cut, audit + "K")
            for symbol in "ua":
                _merge(out, push(node, symbol), cost + cut + RETYPE, audit + "R")
    return _inserts(out)


def ways(rows: list[tuple], starts: tuple[int, ...]) -> list[dict]:
    """From each stack of ``starts`` to each stack: least cost and audit over rows of ``(role, text, fault)``."""
    found = []
    for start in starts:
        front = {STACKS[start]: (0, "")}
        for role, _, fault in rows:
            front = step(front, role[:1], fault)
        found += [{"start": start, "end": _PLACE[n], "cost": c, "audit": a} for n, (c, a) in front.items()]
    return found


def whole(rows: list[tuple]) -> tuple[int, str]:
    """Least cost and its least audit for a whole conversation."""
    front = _inserts({EMPTY: (0, "")})
    for role, _, fault in rows:
        front = step(front, role[:1], fault)
    return min(front[STACKS[i]] for i in _ENDS if STACKS[i] in front)


def apply(rows: list[tuple], audit: str, start: int = 0) -> list[dict]:
    """The repaired turns, each with the edit that made it, from the stack ``start``."""
    node, left, out = STACKS[start], iter(rows), []
    for edit in audit:
        role, text, _ = ("", "", 0) if edit == "I" else next(left)
        if edit == "D":
            continue
        if edit in "IR":
            symbol = next(s for s in "ua" if push(node, s))
            role = _ROLES[symbol]
        node = push(node, role[:1])
        out.append({"edit": edit, "role": role, "text": text})
    return out


def illegal(rows: list[tuple]) -> int:
    initials = [r[0][:1] for r in rows]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


# Rows and their faults -----------------------------------------------------------


def _key(column: Column) -> Column:
    """A text that tells null from every value."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def faults(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, turn, role, text, fault, row`` in no order; null roles and texts become one space.

    A row's fault is its first of: blank, duplicate (role and text seen earlier
    in the conversation), truncated (the last character that is not blank is
    none of ``.!?``). Rows of one turn stand in the order of role, text; equal
    ones behind each other, so all but one of these are duplicates.
    """
    space = F.lit(" ")
    rows = df.select(
        _key(F.col(conv)).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), space).alias("role"),
        F.coalesce(F.col(text), space).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    said = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "row")
    thin = rows.select("conv", said.alias("said"), place.alias("place"))
    again = thin.groupBy("conv", "said").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again, _ = pinned(again.select("conv", "said", "first"), "said-again")
    met = rows.withColumns({"said": said, "place": place}).join(again, ["conv", "said"], "left")
    rest = F.rtrim(F.col("text"), F.lit(_BLANKS))
    fault = (
        F.when(rest == "", BLANK)
        .when(F.col("place") > F.col("first"), DUPLICATE)
        .when(~F.right(rest, F.lit(1)).isin(".", "!", "?"), TRUNCATED)
        .otherwise(0)
    )
    return met.select("conv", "turn", "role", "text", fault.alias("fault"), "row")


# Segments ------------------------------------------------------------------------

_TURNS = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
_WAYS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_READ = pa.schema(
    [("conv", pa.string()), ("part", pa.int32()), ("segment", pa.int64()), ("n", pa.int64())]
    + [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("turns", _TURNS), ("ways", _WAYS)]
    + [("first", pa.string()), ("last", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("faults", pa.list_(pa.int32()))]
)
_TURNS_SQL = "array<struct<edit: string, role: string, text: string>>"
_READ_SQL = (
    "conv string, part int, segment long, n long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    f"turns {_TURNS_SQL}, ways array<struct<start: int, end: int, cost: long, audit: string>>, "
    "first string, last string, roles array<string>, texts array<string>, faults array<int>"
)
_OUT = 1024


def _batches(records, schema: pa.Schema, size: int = 4 << 20):
    """Record batches of at most ``_OUT`` rows, closed early once their texts exceed ``size``."""
    held, weight = [], 0
    for record, chars in records:
        held.append(record)
        weight += chars
        if len(held) >= _OUT or weight > size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _segments(batches, size: int):
    """``conv, rows, opens, closes`` for runs of at most ``size`` rows of a conversation.

    ``opens`` and ``closes``: the run surely begins or ends the conversation. The
    first and the last conversation of a partition may go on in its neighbours.
    """
    conv, rows, opens = None, [], False
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv", "role", "text", "fault")]
        for now, *row in zip(*columns):
            if now != conv:
                if rows:
                    yield conv, rows, opens, True
                opens, rows = conv is not None, []
                conv = now
            elif len(rows) == size:
                yield conv, rows, opens, False
                opens, rows = False, []
            rows.append(tuple(row))
    if rows:
        yield conv, rows, opens, False


def _read(batches, size: int):
    part = TaskContext.get().partitionId()

    def records():
        for at, (conv, rows, opens, closes) in enumerate(_segments(batches, size)):
            kinds = [r[2] for r in rows]
            record = {"conv": conv, "part": part, "segment": at, "n": len(rows), "illegal": illegal(rows)}
            record |= {"blank": kinds.count(BLANK), "duplicate": kinds.count(DUPLICATE), "truncated": kinds.count(TRUNCATED)}
            if opens and closes:
                record["cost"], record["audit"] = whole(rows)
                record["turns"] = apply(rows, record["audit"])
            else:
                record["ways"] = ways(rows, (0, 1, 2, 3))
                record["first"], record["last"] = rows[0][0][:1], rows[-1][0][:1]
                record["roles"], record["texts"], record["faults"] = map(list, zip(*rows))
            yield record, sum(len(r[1]) for r in rows)

    yield from _batches(records(), _READ)


def _fold(front: dict, table: list[dict]) -> tuple[dict, dict]:
    """The front behind a segment, and for each of its stacks the one before the segment."""
    out, via = {}, {}
    for way in table:
        before = front.get(way["start"])
        if before is None:
            continue
        new = (before[0] + way["cost"], before[1] + way["audit"])
        if way["end"] not in out or new < out[way["end"]]:
            out[way["end"]], via[way["end"]] = new, way["start"]
    # What these two can still become, the stack after a can become as well, at 3 and at 0 more.
    if out.get(0, (0,))[0] > out[3][0] + DELETE:
        del out[0]
    if out.get(1, (0,))[0] > out[3][0]:
        del out[1]
    return out, via


_SETTLED = pa.schema(
    [("conv", pa.string()), ("part", pa.int32()), ("segment", pa.int64()), ("start", pa.int32()), ("edits", pa.string())]
    + [(c, pa.int64()) for c in ("cost", "border")]
)


def _settle(batches):
    """Edits of every segment from the tables of a conversation's segments, which arrive in order."""

    def settled(conv, segments):
        opening = _inserts({EMPTY: (0, "")})
        front = {_PLACE[node]: value for node, value in opening.items()}
        steps, settled_prefix, border, last = [], 0, 0, None
        for s in segments:
            if last is not None and last + s["first"] not in ("su", "ua", "au"):
                border += 1
            last = s["last"]
            front, via = _fold(front, s["ways"])
            steps.append((s, via))
            # Only what differs between the stacks has to be compared later.
            settled_prefix = len(commonprefix([audit for _, audit in front.values()]))
            front = {k: (c, a[settled_prefix:]) for k, (c, a) in front.items()}
        end = min((i for i in _ENDS if i in front), key=lambda i: front[i])
        cost = front[end][0]
        edits = []
        for s, via in reversed(steps):
            start = via[end]
            edits.append((s, start, next(w["audit"] for w in s["ways"] if (w["start"], w["end"]) == (start, end))))
            end = start
        edits.reverse()
        lead = opening[STACKS[end]][1]
        for i, (s, start, audit) in enumerate(edits):
            record = {"conv": conv, "part": s["part"], "segment": s["segment"], "start": start, "edits": audit, "cost": 0, "border": 0}
            if i == 0:  # inserts before the first row, from the empty stack
                record |= {"start": 0, "edits": lead + audit, "cost": cost, "border": border}
            yield record, len(audit)

    def records():
        conv, held = None, []
        for batch in batches:
            for s in batch.to_pylist():
                if held and s["conv"] != conv:
                    yield from settled(conv, held)
                    held = []
                conv = s["conv"]
                held.append(s)
        if held:
            yield from settled(conv, held)

    yield from _batches(records(), _SETTLED)


_PIECE = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("segment", pa.int64()), ("turns", _TURNS)])


def _rewrite(batches):
    def records():
        for batch in batches:
            for s in batch.to_pylist():
                rows = list(zip(s["roles"], s["texts"], s["faults"]))
                turns = apply(rows, s["edits"], s["start"])
                yield {"conv": s["conv"], "part": s["part"], "segment": s["segment"], "turns": turns}, sum(map(len, s["texts"]))

    yield from _batches(records(), _PIECE)


def _digest(batches):
    """Checksums of conversations of several pieces, which stream by in order."""

    def records():
        conv, total, lines = None, None, 0
        for batch in batches:
            for name, text, n in zip(*[batch.column(c).to_pylist() for c in ("conv", "piece", "lines")]):
                if total is None or name != conv:
                    if total is not None:
                        yield {"conv": conv, "repaired_sha256": total.hexdigest()}, 0
                    conv, total, lines = name, hashlib.sha256(), 0
                if n:
                    total.update((("\n" if lines else "") + text).encode())
                    lines += n
        if total is not None:
            yield {"conv": conv, "repaired_sha256": total.hexdigest()}, 0

    yield from _batches(records(), pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())]))


class Repair:
    """Repaired conversations: ``conversations`` (one row each) and ``pieces`` (their turns, in order).

    Nulls: a null conversation id is a conversation of its own; null turns come
    first; null roles and texts are one space, so such a row is blank or has no
    legal role. Rows of one turn are ordered by role and text, repeated rows are
    duplicates. Any role may occur; one that fits nowhere is reroled or deleted.
    Other columns play no part. An empty table gives no rows.
    """

    def __init__(
        self, df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT
    ):
        text_batches(df.sparkSession)
        self.rows = faults(df, conv, turn, role, text)
        order = ["conv", "turn", "role", "text", "row"]
        placed = self.rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "role", "text", "fault")
        self.read, _ = pinned(placed.mapInArrow(lambda b: _read(b, segment), _READ_SQL), "segments")
        # Split conversations: tables without texts along the conversation, then the texts by segment.
        split = self.read.filter("ways is not null")
        tables = split.select("conv", "part", "segment", "ways", "first", "last").repartition("conv")
        ordered = tables.sortWithinPartitions("conv", "part", "segment")
        schema = "conv string, part int, segment long, start int, edits string, cost long, border long"
        self.settled, _ = pinned(ordered.mapInArrow(_settle, schema), "settled")

    def conversations(self) -> DataFrame:
        """``conv`` (as text that tells null), ``gaps, blank, duplicate, truncated, illegal, cost, audit``."""
        counts = ["blank", "duplicate", "truncated", "illegal"]
        at = ["conv", "part", "segment"]
        done = self.read.join(self.settled.withColumnRenamed("cost", "settled_cost"), at, "left")
        edits = F.struct("part", "segment", F.coalesce("audit", "edits", F.lit("")).alias("edits"))
        parts = done.groupBy("conv").agg(
            *[F.sum(c).alias(c) for c in counts],
            F.sum(F.coalesce("cost", "settled_cost")).alias("cost"),
            F.coalesce(F.sum("border"), F.lit(0)).alias("border"),
            F.array_join(F.transform(F.sort_array(F.collect_list(edits)), lambda e: e["edits"]), "").alias("audit"),
        )
        span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
        gaps = self.rows.groupBy("conv").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"))
        illegal_pairs = (F.col("illegal") + F.col("border")).alias("illegal")
        return parts.join(gaps, "conv").select("conv", "gaps", "blank", "duplicate", "truncated", illegal_pairs, "cost", "audit")

    def pieces(self) -> DataFrame:
        """``conv, part, segment, turns, split``: repaired turns with the edits that made them, in order of part and segment."""
        at = ["conv", "part", "segment"]
        one = self.read.filter("ways is null").select(*at, "turns", F.lit(False).alias("split"))
        held = self.read.filter("ways is not null").select(*at, "roles", "texts", "faults")
        sent = held.join(self.settled.select(*at, "start", "edits"), at)
        some = sent.mapInArrow(_rewrite, f"conv string, part int, segment long, turns {_TURNS_SQL}")
        return one.unionByName(some.withColumn("split", F.lit(True)))

    def digests(self) -> DataFrame:
        """``conv, repaired_sha256`` over the repaired turns, ``role:text`` joined by line feeds.

        The checksum of a conversation is sequential: its pieces stream through one task, which holds one batch.
        """
        lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
        pieces = self.pieces().select("conv", "part", "segment", "split", F.size("turns").alias("lines"), F.array_join(lines, "\n").alias("piece"))
        one = pieces.filter("not split").select("conv", F.sha2(F.col("piece"), 256).alias("repaired_sha256"))
        some = pieces.filter("split").repartition("conv").sortWithinPartitions("conv", "part", "segment")
        return one.unionByName(some.mapInArrow(_digest, "conv string, repaired_sha256 string"))


# The test bed of the registered query ---------------------------------------------


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with the faults that the checksum of ``conv:turn`` names: dropped, emptied, unpunctuated, repeated, reroled."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)]
    draw = F.crc32(F.concat(parts[0], F.lit(":"), parts[1])) % 20
    said = F.coalesce(F.col(text), F.lit(" "))
    hurt = df.select(
        F.col(conv),
        F.col(turn),
        F.when(draw == 4, F.lit("user")).otherwise(F.coalesce(F.col(role), F.lit(" "))).alias(role),
        F.when(draw == 1, F.lit("")).when(draw == 2, F.translate(said, ".!?", "")).otherwise(said).alias(text),
        F.explode(F.when(draw == 0, F.array().cast("array<int>")).when(draw == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
    )
    return hurt.drop("col")


def repaired_conversations(df: DataFrame, rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation of ``df``, as its ``rows`` are repaired; without rows: zeros, empty audit, checksum of nothing."""
    fixed = Repair(rows, conv)
    every = df.select(F.col(conv)).distinct().withColumn("conv", _key(F.col(conv)))
    told = every.join(fixed.conversations(), "conv", "left").join(fixed.digests(), "conv", "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return told.select(
        conv,
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
