"""The prefix trie of conversations: how many share each run of first turns, and what that would save.

Each conversation is an array of turn ids (16 bytes of MD5 of role and text) joined into one binary key. The keys are sorted
globally, by ranges of (key, conv_id), so that equal conversations may spread over partitions. In a partition, the longest common
prefix of neighbours says which nodes end and which begin: a stack of the nodes on the current path is swept along, and a node
that leaves the stack is complete. Only nodes on the path of a partition's first or last conversation may go on in another
partition; they are passed on as pieces with the sums so far. One sweep over the pieces of all partitions, in their order, stitches
them: as many rows as two paths for each partition, whatever the number of conversations.

A node's parent is named by its smallest member, which is only known when the parent is complete. Nodes wait for it in their
parent's entry of the stack; those that can't (their parent is a piece, or WAITING others wait) get it by a join on the
parent's entry, whose number is of its partition, so that the root isn't one hot key.

Turns are in the order of `turn`, null first, ties by id. A null role or text is the empty string. Rows without a conv_id belong to no
conversation and are left out. Repeated rows are repeated turns. A conversation without turns is a member of the root only. An empty
table has no nodes. Other columns are ignored, whatever their names. Texts of any length count as 16 bytes after the first step. A
conversation is one row of 20 bytes a turn, and so are the ids of one node's ends in a hash: both are in the nature of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.llm.common import drop_stored, stored

ID = 16
#: Nodes that wait for their parent's name at most; more get it by a join.
WAITING = 4096
#: Characters of one row of a piece's ids, or so.
CHUNK = 1 << 20
_NODE, _UNNAMED, _NAME, _PIECE, _ENDS = range(5)
_SCHEMA = (
    "kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, ref long, part int, step int, place int, id binary, words long, ids string"
)
_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]
_RESULT = _COLUMNS[1:9]
_ARROW = pa.schema(
    [(c, {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k]) for c, k in (x.split() for x in _SCHEMA.split(", "))]
)


def turn_lists(chats: DataFrame) -> DataFrame:
    """(conv_id, turns: array of id in hex and words, in order), a row for each conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.col("turn").cast("long")
    rows = chats.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            turn.isNotNull().alias("known"),
            turn.alias("turn"),
            F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("id"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
        ).alias("t"),
    )
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return lists.select("conv_id", F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns"))


def grafted(lists: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of c - c % group; h is crc32 of c in decimal, modulo most."""
    first = lists.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, max(1, most - 1)).alias("head")
    )
    rows = lists.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % most).cast("int"))
    rows = rows.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(first, "base", "left")
    none = F.slice("turns", 1, 0)
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), none)
    return rows.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns") + 1)).alias("turns"))


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two keys begin with alike."""
    low, high = 0, min(len(a), len(b)) // ID
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * ID : mid * ID] == b[low * ID : mid * ID]:
            low = mid
        else:
            high = mid - 1
    return low


class _Rows:
    """Rows of _SCHEMA, given out as Arrow batches."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, **values: object) -> None:
        self.rows.append(tuple(map(values.get, _COLUMNS)))

    def batches(self, least: int = 8192) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            columns = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)
            self.rows = []


class _Entry:
    """A node on the path, with the sums over what is complete below it."""

    __slots__ = ("id", "words", "refs", "convs", "least", "children", "leaves", "saved", "ends", "any", "waiting", "named_late", "step", "recent", "packed", "chunks")

    def __init__(self, id: bytes, words: int, ref: int, step: int | None = None) -> None:
        self.id, self.words, self.refs, self.step = id, words, [ref], step
        self.convs = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends, self.any = hashlib.sha256(), False
        self.waiting: list[dict] = []
        self.named_late = False
        self.recent: list[str] = []  # ids that end here, and before them joined ones
        self.packed: list[str] = []
        self.chunks = 0

    def take(self, convs: int, least: int | None, children: int, leaves: int, saved: int) -> None:
        self.convs += convs
        self.children += children
        self.leaves += leaves
        self.saved += saved
        if least is not None:
            self.least = least if self.least is None else min(self.least, least)

    def end(self, ids: str) -> None:
        self.ends.update(("," * self.any + ids).encode())
        self.any = True


def _unnamed(entry: _Entry, out: _Rows) -> None:
    for node in entry.waiting:
        out.add(kind=_UNNAMED, ref=entry.refs[0], **node)
    entry.waiting = []


def _close(entry: _Entry, depth: int, parent: _Entry | None, out: _Rows) -> None:
    """A node that is complete: name it to those that wait, and add it to its parent."""
    for node in entry.waiting:
        out.add(kind=_NODE, parent_conv_id=entry.least, **node)
    if entry.named_late:
        for ref in entry.refs:
            out.add(kind=_NAME, ref=ref, conv_id=entry.least)
    leaves = entry.leaves if entry.children else 1
    saved = entry.saved + (entry.convs - 1) * entry.words
    node = dict(
        conv_id=entry.least, depth=depth, n_convs=entry.convs, n_children=entry.children, n_leaves=leaves,
        saved_tokens=saved, ends_sha256=entry.ends.hexdigest(),
    )
    if parent is None:
        out.add(kind=_NODE, **node)
        return
    parent.waiting.append(node)
    parent.take(entry.convs, entry.least, 1, leaves, saved)
    if len(parent.waiting) >= WAITING:
        parent.named_late = True
        _unnamed(parent, out)


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (conv_id, key, words), sorted, to complete nodes and pieces."""
    part = TaskContext.get().partitionId()
    out, path, before, made = _Rows(), [], None, 0

    def pack(entry: _Entry, depth: int, whole: bool) -> None:
        """Join the recent ids; those of a piece are passed on."""
        if len(entry.recent) * 8 >= CHUNK or whole and entry.recent:
            entry.packed.append(",".join(entry.recent))
            entry.recent = []
        if entry.step is not None:
            for ids in entry.packed:
                entry.chunks += 1
                out.add(kind=_ENDS, part=part, step=entry.step, depth=depth, place=entry.chunks, ids=ids)
            entry.packed = []

    def leave(last: bool = False) -> None:
        entry = path.pop()
        if last and entry.step is None:
            entry.step = 1
        pack(entry, len(path), whole=True)
        if entry.step is None:
            for ids in entry.packed:
                entry.end(ids)
            _close(entry, len(path), path[-1], out)
            return
        _unnamed(entry, out)
        out.add(
            kind=_PIECE, part=part, step=entry.step, depth=len(path), place=0, id=entry.id, words=entry.words, ref=entry.refs[0],
            n_convs=entry.convs, conv_id=entry.least, n_children=entry.children, n_leaves=entry.leaves, saved_tokens=entry.saved,
        )

    for batch in batches:
        for conv, key, words in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            key = key.as_py()
            if key != before:
                keep = 0 if before is None else 1 + common_turns(before, key)
                while len(path) > keep:
                    leave()
                turn_words = words.as_py()
                for d in range(len(path), len(key) // ID + 1):
                    made += 1
                    path.append(
                        _Entry(key[(d - 1) * ID : d * ID] if d else b"", turn_words[d - 1] if d else 0, (part << 40) + made, 0 if before is None else None)
                    )
                before = key
            top = path[-1]
            top.take(1, conv, 0, 0, 0)
            top.recent.append(str(conv))
            pack(top, len(path) - 1, whole=False)
        yield from out.batches()
    while path:
        leave(last=True)
    yield from out.batches(1)


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From all partitions' pieces, in order, to their nodes."""
    out, path = _Rows(), []

    def leave() -> None:
        entry = path.pop()
        _close(entry, len(path), path[-1] if path else None, out)

    for batch in batches:
        for row in batch.to_pylist():
            depth = row["depth"]
            if row["kind"] == _ENDS:
                path[depth].end(row["ids"])
                continue
            if depth < len(path) and path[depth].id == row["id"]:
                path[depth].refs.append(row["ref"])
            else:
                while len(path) > depth:
                    leave()
                path.append(_Entry(row["id"], row["words"], row["ref"]))
                path[-1].named_late = True
            path[depth].take(row["n_convs"], row["conv_id"], row["n_children"], row["n_leaves"], row["saved_tokens"])
        yield from out.batches()
    while path:
        leave()
    yield from out.batches(1)


def trie(lists: DataFrame) -> DataFrame:
    """A row for each node of the trie of lists (conv_id, turns), as in the contract of the query.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    each = lambda f: F.transform("turns", lambda t: t[f])
    keys = lists.select("conv_id", F.unhex(F.array_join(each("id"), "")).alias("key"), each("words").alias("words"))
    keys = stored(keys, "turns")
    rows = keys.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    made = stored(rows.mapInArrow(_swept, _SCHEMA), "trie")
    pieces = made.where(F.col("kind").isin(_PIECE, _ENDS)).repartition(1).sortWithinPartitions("part", "step", "depth", "place")
    ends = stored(pieces.mapInArrow(_stitched, _SCHEMA), "stitched")
    drop_stored(keys)
    whole = made.unionByName(ends)
    kind: Column = F.col("kind")
    names = whole.where(kind == _NAME).select("ref", F.col("conv_id").alias("named"))
    late = whole.where(kind == _UNNAMED).join(names, "ref").withColumn("parent_conv_id", F.col("named"))
    return whole.where(kind == _NODE).select(*_RESULT).unionByName(late.select(*_RESULT))
