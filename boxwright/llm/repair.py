"""Cheapest repair of conversations into turns that alternate, with an audit of the edits.

A conversation is repaired by keeping (K, 0), re-roling (R, 2) or deleting (D, 3) each of its turns and by inserting turns
without text (I, 2), so that the initials of its roles are `(s?(ua)+)?`. Blank and duplicate turns must be deleted, truncated ones
that stay cost 1. Of the cheapest audits the ASCII-least counts.

It is a dynamic program over the four states of that pattern. A step is a macro edit, a run of inserts and what happens to the next
turn: `I..IK`, `I..IR` or `I..ID`. No code of these begins another, so of two audits up to a turn, neither begins the other,
and more edits don't change their order. Audits are therefore not kept as strings: a layer has for each state the cost, the
rank of its audit among the layer's and a pointer to its parent and code; (rank of the parent, place of the code in ASCII order) ranks
the next layer. The audit is read back through the pointers.

Steps of a part of a conversation compose: for each state at its start, a piece has the costs and ranks at its end. Turns are sorted
globally, by ranges of (conv_id, turn). A conversation that lies inside a partition is repaired there. One that may go on in
another, or of more than PIECE turns or PIECE_BYTES of text, is cut into pieces; their tables are chained, and each piece is
walked again from the state in which the chain enters it. So no task holds more than a piece, though the digest of a text is one
pass over it, in one task, and the audit is one string: both are in the nature of the result.

Roles and texts that are null are one space. Turns are in the order of `turn`, null first, ties by role and MD5 of the text;
equal rows are counted as one with its number. A null conv_id is a conversation of its own. A role of no letters has no initial. Texts
may be empty or of any length up to what a row can hold. Numbers beyond 64 bits are cut to the largest one. An empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.llm.common import drop_stored, stored

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Turns and bytes of text of a piece at most, but for a single turn of more.
PIECE = 1 << 16
PIECE_BYTES = 1 << 25

_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_STATES = range(4)
_NEXT = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
#: The role that is inserted or given in each state, and the state that follows.
_GIVEN = {q: ("assistant", _ASSISTANT) if q == _USER else ("user", _USER) for q in _STATES}
#: Inserts that lead from a state to an end of the pattern.
_TO_END = {_START: 0, _SYSTEM: 2, _USER: 1, _ASSISTANT: 0}
_MOST_INSERTS = 2  # before a turn two bring any state to any other that inserts reach; more are a pair too many
_CODES = sorted("I" * k + x for k in range(_MOST_INSERTS + 1) for x in "DKR")
_FINE, _CUT, _GONE = range(3)
_LEGAL = {"su", "ua", "au"}
_LARGEST = (1 << 63) - 1


@cache
def _moves(initial: str, fault: int) -> list[tuple[int, int, int, int]]:
    """(state before, code, state after, cost) of each macro edit that a turn allows."""
    out = []
    for p in _STATES:
        for code, edits in enumerate(_CODES):
            q, cost = p, 0
            for _ in edits[:-1]:
                q, cost = _GIVEN[q][1], cost + INSERT
            if edits[-1] == "D":
                cost += DELETE
            elif fault == _GONE:
                continue
            elif edits[-1] == "R":
                q, cost = _GIVEN[q][1], cost + REROLE
            elif (q, initial) in _NEXT:
                q, cost = _NEXT[q, initial], cost + KEEP
            else:
                continue
            out.append((p, code, q, cost + (TRUNCATED if fault == _CUT and edits[-1] != "D" else 0)))
    return out


Layer = list[tuple[int, int] | None]  # for each state the cost and the rank of the best audit


def _step(layer: Layer, initial: str, fault: int) -> tuple[Layer, list[tuple[int, int]]]:
    """The next layer, and each state's parent and code."""
    best: list[tuple[int, int, int, int] | None] = [None] * 4
    for p, code, q, cost in _moves(initial, fault):
        if (at := layer[p]) is not None:
            found = (at[0] + cost, at[1], code, p)
            if best[q] is None or found < best[q]:
                best[q] = found
    ranks = {q: r for r, (_, _, q) in enumerate(sorted((b[1], b[2], q) for q, b in enumerate(best) if b))}
    return [(b[0], ranks[q]) if b else None for q, b in enumerate(best)], [(b[3], b[2]) if b else (0, 0) for b in best]


def _ended(layer: Layer) -> tuple[int, int]:
    """The cheapest end: its cost and the last layer's state."""
    ends = [(at[0] + INSERT * _TO_END[q], at[1], q) for q, at in enumerate(layer) if at is not None]
    cost, _, state = min(ends)
    return cost, state


class _Totals:
    """Counts of faults over a run of turns; two runs in a row can be added."""

    __slots__ = ("blank", "duplicate", "truncated", "illegal", "first", "last", "least", "most", "turns")
    FIELDS = "blank long, duplicate long, truncated long, illegal long, first string, last string, least long, most long, turns long"

    def __init__(self, *values: object) -> None:
        self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last, self.least, self.most, self.turns = values or (0, 0, 0, 0, None, None, None, None, 0)

    def values(self) -> tuple:
        return tuple(getattr(self, f) for f in self.__slots__)

    def add(self, x: _Totals) -> None:
        self.illegal += x.illegal + (self.last is not None and x.first is not None and self.last + x.first not in _LEGAL)
        self.turns += x.turns - (x.turns > 0 and self.most == x.least)
        for f in ("blank", "duplicate", "truncated"):
            setattr(self, f, getattr(self, f) + getattr(x, f))
        self.first = x.first if self.first is None else self.first
        self.last = self.last if x.last is None else x.last
        self.least = x.least if self.least is None else self.least
        self.most = self.most if x.most is None else x.most

    def result(self) -> tuple[int, ...]:
        gaps = 0 if self.least is None else min(_LARGEST, self.most - self.least + 1 - self.turns)
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


Turn = tuple[str, int, str, bytes]  # initial, fault, role, text


class _Piece:
    """Turns of a conversation in a row."""

    def __init__(self) -> None:
        self.turns: list[Turn] = []
        self.bytes = 0
        self.totals = _Totals()

    def full(self) -> bool:
        return len(self.turns) >= PIECE or self.bytes >= PIECE_BYTES

    def add(self, turn: int | None, role: str, text: bytes, kind: int) -> None:
        """kind: 0 fine, 1 blank, 2 duplicate, 3 truncated."""
        initial = role[:1]
        self.turns.append((initial, _CUT if kind == 3 else _GONE if kind else _FINE, role, b"" if kind in (1, 2) else text))
        self.bytes += len(text)
        self.totals.add(_Totals(int(kind == 1), int(kind == 2), int(kind == 3), 0, initial, initial, turn, turn, int(turn is not None)))

    def table(self) -> tuple[list[int], list[int]]:
        """For each state before and after the cost and the rank; -1 where there is no way."""
        costs, ranks = [], []
        for p in _STATES:
            layer: Layer = [(0, 0) if q == p else None for q in _STATES]
            for initial, fault, _, _ in self.turns:
                layer, _ = _step(layer, initial, fault)
            costs += [-1 if at is None else at[0] for at in layer]
            ranks += [-1 if at is None else at[1] for at in layer]
        return costs, ranks

    def walk(self, state: int) -> tuple[Layer, list[list[tuple[int, int]]]]:
        layer: Layer = [(0, 0) if q == state else None for q in _STATES]
        pointers = []
        for initial, fault, _, _ in self.turns:
            layer, up = _step(layer, initial, fault)
            pointers.append(up)
        return layer, pointers


class _Writer:
    """The audit and the digest of what is repaired so far."""

    def __init__(self) -> None:
        self.audit: list[str] = []
        self.digest = hashlib.sha256()
        self.state = _START
        self.any = False

    def say(self, role: str, text: bytes) -> None:
        self.digest.update((b"\n" if self.any else b"") + role.encode() + b":")
        self.digest.update(text)
        self.any = True

    def insert(self) -> None:
        role, self.state = _GIVEN[self.state]
        self.say(role, b"")

    def piece(self, piece: _Piece, pointers: list[list[tuple[int, int]]], end: int) -> None:
        codes, q = [], end
        for up in reversed(pointers):
            q, code = up[q]
            codes.append(_CODES[code])
        codes.reverse()
        for edits, (initial, _, role, text) in zip(codes, piece.turns, strict=True):
            for _ in edits[:-1]:
                self.insert()
            if edits[-1] == "K":
                self.state = _NEXT[self.state, initial]
                self.say(role, text)
            elif edits[-1] == "R":
                role, self.state = _GIVEN[self.state]
                self.say(role, text)
        self.audit.append("".join(codes))

    def end(self) -> tuple[str, str]:
        self.audit.append("I" * _TO_END[self.state])
        for _ in range(_TO_END[self.state]):
            self.insert()
        return "".join(self.audit), self.digest.hexdigest()


_RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
_RESULT_TYPE = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_DONE, _HEAD, _TURN = range(3)  # a conversation's result, a piece's table, one of its turns
_PARTS = (
    f"what int, conv_id long, part int, piece int, place int, role string, text binary, kind int, "
    f"costs array<long>, ranks array<int>, totals struct<{_Totals.FIELDS.replace(' ', ':').replace(',:', ',')}>, result struct<{_RESULT_TYPE.replace(' ', ':').replace(',:', ',')}>"
)
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_struct = lambda fields: pa.struct([(n, _ARROW[k]) for n, k in (x.split() for x in fields.split(", "))])
_PARTS_ARROW = pa.schema(
    [
        *((c, _ARROW[k]) for c, k in (x.split() for x in "what int, conv_id long, part int, piece int, place int, role string, text binary, kind int".split(", "))),
        ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), ("totals", _struct(_Totals.FIELDS)), ("result", _struct(_RESULT_TYPE)),
    ]
)


class _Out:
    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, size: int = 0, **values: object) -> None:
        self.rows.append(values)
        self.bytes += size

    def batches(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if self.rows and (last or len(self.rows) >= 4096 or self.bytes >= PIECE_BYTES):
            columns = [pa.array([r.get(f.name) for r in self.rows], f.type) for f in self.schema]
            self.rows, self.bytes = [], 0
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (conv_id, turn, role, text, n, kind), sorted, to results of whole conversations and pieces of others."""
    part = TaskContext.get().partitionId()
    out, piece, conv = _Out(_PARTS_ARROW), _Piece(), None
    opened, pieces = True, 0  # whether the conversation may have begun before; its pieces so far

    def cut() -> None:
        nonlocal piece, pieces
        costs, ranks = piece.table()
        totals = dict(zip(_Totals.__slots__, piece.totals.values(), strict=True))
        out.add(what=_HEAD, conv_id=conv, part=part, piece=pieces, place=-1, costs=costs, ranks=ranks, totals=totals)
        for k, (_, fault, role, text) in enumerate(piece.turns):
            out.add(len(text), what=_TURN, conv_id=conv, part=part, piece=pieces, place=k, role=role, text=text, kind=fault)
        piece, pieces = _Piece(), pieces + 1

    def ended() -> None:
        nonlocal piece
        if opened or pieces:
            cut()
            return
        layer, pointers = piece.walk(_START)
        cost, state = _ended(layer)
        writer = _Writer()
        writer.piece(piece, pointers, state)
        result = (*piece.totals.result(), cost, *writer.end())
        out.add(what=_DONE, conv_id=conv, result=dict(zip(_RESULT, result, strict=True)))
        piece = _Piece()

    any_row = False
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in (0, 1, 2, 4, 5)]
        for (c, turn, role, n, kind), text in zip(zip(*columns, strict=True), batch.column(3), strict=True):
            if not any_row or c != conv:
                if any_row:
                    ended()
                    opened, pieces = False, 0
                any_row, conv = True, c
            for k in range(n):
                if piece.full():
                    cut()
                piece.add(turn, role, text.as_py(), kind if k == 0 or kind == 1 else 2)
            yield from out.batches()
    if any_row:
        opened = True
        ended()
    yield from out.batches(last=True)


_CHAINED = f"conv_id long, part int, piece int, place int, enters int, leaves int, {_RESULT_TYPE.rsplit(', ', 2)[0]}"
_CHAINED_ARROW = pa.schema([(c, _ARROW[k]) for c, k in (x.split() for x in _CHAINED.split(", "))])


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bool, dict]]:
    """(conv_id, whether it is a new one, row)."""
    now, any_row = None, False
    for batch in batches:
        for row in batch.to_pylist():
            new = not any_row or row["conv_id"] != now
            now, any_row = row["conv_id"], True
            yield now, new, row


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pieces' tables, in order, to the states in which each piece is entered and left; place -2 has a conversation's totals."""
    out = _Out(_CHAINED_ARROW)
    start: Layer = [(0, 0), None, None, None]
    conv, layer, totals, ups = None, start, _Totals(), []

    def ended() -> None:
        cost, q = _ended(layer)
        totals_of = dict(zip(_RESULT, (*totals.result(), cost), strict=False))
        out.add(conv_id=conv, part=-1, piece=-1, place=-2, **totals_of)
        for part, piece, up in reversed(ups):
            out.add(conv_id=conv, part=part, piece=piece, place=-2, enters=up[q], leaves=q)
            q = up[q]

    for c, new, row in _by_conversation(batches):
        if new:
            if ups:
                ended()
                yield from out.batches()
            conv, layer, totals, ups = c, start, _Totals(), []
        totals.add(_Totals(*(row["totals"][f] for f in _Totals.__slots__)))
        best: list[tuple | None] = [None] * 4
        for p, at in enumerate(layer):
            for q in _STATES:
                if at is not None and row["costs"][4 * p + q] >= 0:
                    found = (at[0] + row["costs"][4 * p + q], at[1], row["ranks"][4 * p + q], p)
                    best[q] = found if best[q] is None else min(best[q], found)
        ranks = {q: r for r, (_, _, q) in enumerate(sorted((b[1], b[2], q) for q, b in enumerate(best) if b))}
        layer = [(b[0], ranks[q]) if b else None for q, b in enumerate(best)]
        ups.append((row["part"], row["piece"], bytes(b[3] if b else 0 for b in best)))
    if ups:
        ended()
    yield from out.batches(last=True)


_FINAL = f"conv_id long, {_RESULT_TYPE}"
_FINAL_ARROW = pa.schema([(c, _ARROW[k]) for c, k in (x.split() for x in _FINAL.split(", "))])


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From totals, pieces' states and their turns, in order, to results."""
    out = _Out(_FINAL_ARROW)
    totals: dict | None = None
    writer, piece, states = _Writer(), _Piece(), None

    def flush() -> None:
        nonlocal piece
        if states is not None:
            _, pointers = piece.walk(states[0])
            writer.piece(piece, pointers, states[1])
        piece = _Piece()

    def ended() -> None:
        flush()
        audit, digest = writer.end()
        out.add(len(audit), **{f: totals[f] for f in ("conv_id", *_RESULT[:6])}, audit=audit, repaired_sha256=digest)

    for _, new, row in _by_conversation(batches):
        if new:
            if totals is not None:
                ended()
                yield from out.batches()
            totals, writer, states = row, _Writer(), None
        elif row["place"] == -2:
            flush()
            states = (row["enters"], row["leaves"])
        else:
            piece.turns.append((row["role"][:1], row["kind"], row["role"], row["text"]))
    if totals is not None:
        ended()
    yield from out.batches(last=True)


def damaged(chats: DataFrame) -> DataFrame:
    """Turns with the faults that crc32 of `conv_id:turn` gives them, for tests of the repair: conv_id, turn, role, text, n (its number)."""
    blank = F.lit(" ")
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    fault = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    return chats.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(text_of("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text")).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def repaired(turns: DataFrame) -> DataFrame:
    """A row for each conversation of turns (conv_id, turn, role, text, n: how often the row counts, 0 for not at all).

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    same = F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text"))
    rows = turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    rows = rows.withColumn("same", F.unhex(same)).withColumn("place", F.struct(F.col("turn").isNotNull(), "turn"))
    rows = stored(rows, "turns")
    first = rows.where("n > 0").groupBy("same").agg(F.min("place").alias("first"))
    rest = F.rtrim(F.col("text"), F.lit(SPACE))
    kind: Column = (
        F.when(rest == "", 1).when(F.col("first") < F.col("place"), 2).when(F.right(rest, F.lit(1)).isin(".", "!", "?"), 0).otherwise(3)
    )
    rows = rows.join(first, "same", "left").select(
        "conv_id", "turn", "role", F.col("text").cast("binary").alias("text"), "n", kind.cast("int").alias("kind"), "place", "same",
    )
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("place"), F.asc("role"), F.asc("same")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = stored(rows.select("conv_id", "turn", "role", "text", "n", "kind").mapInArrow(_walked, _PARTS), "repairs")
    heads = parts.where(F.col("what") == _HEAD).select("conv_id", "part", "piece", "costs", "ranks", "totals")
    chained = heads.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInArrow(_chained, _CHAINED)
    said = parts.where(F.col("what") == _TURN).select("conv_id", "part", "piece", "place", "role", "text", "kind")
    both = chained.unionByName(said, allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece", "place")
    done = parts.where(F.col("what") == _DONE).select("conv_id", "result.*")
    return done.unionByName(both.mapInArrow(_written, _FINAL))
