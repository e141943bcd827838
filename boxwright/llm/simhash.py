"""Near-duplicate components by SimHash, with an exact tiled search of all fingerprints.

A fingerprint's bit is 1 if it is set in over half of the 64-bit hashes (XXH64, seed 42) of a text's runs of SHINGLE
words, repeats included. Two fingerprints that differ in at most RADIUS bits are linked, and all pairs are compared
that could be: no link is lost. Equal fingerprints are one vertex, so groups of copies cost nothing further.

The search is by tiles. A half of a fingerprint (32 bits) has 8 blocks of 4 bits, whose population counts are the half's
tile. Of two fingerprints that differ in up to 3 bits, one half differs in 0 or 1: then its counts are equal, or one
count is larger by 1. So each fingerprint is at home in one tile of each half and visits those with one larger count, at
most 18 rows in all, and every pair meets in a tile at home, or as visitor and home. Tiles of the same pair of counts that
differ more than that never meet. Inside a tile, fingerprints lie in order of the population count of all 64 bits, in
smaller tiles of SIDE; a pair of these whose counts differ beyond the radius is skipped, the others are compared with
numpy, exclusive-or and bit counts. A tile with more than MOST_HOMES at home is dealt out to several tasks, which its visitors
all see. Links that join nothing new within a task are left out, so a group of n near copies gives n - 1 links or so, not n * n.
Components are found over the links of all tasks (order_minhash.components).

Words are runs of anything but ASCII white space, after lower-casing A-Z, of the whole text; fewer than SHINGLE words are
one run; a text without words and a null text have fingerprint 0, linked like any other. A component is named by its smallest doc_id;
null doc_ids are rows of components but never name one (a component without any other is named null). Repeated rows are rows of one
component. An empty table gives an empty result; other columns are ignored, whatever their names. Long texts are hashed in
slices. Memory of a task: MOST_HOMES fingerprints and a batch of visitors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm.common import drop_stored, stored
from boxwright.llm.order_minhash import components

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Fingerprints at home in one tile of one task; a tile of more is dealt out.
MOST_HOMES = 1 << 16
#: Fingerprints along a side of the small tiles that numpy compares at once.
SIDE = 1024
#: Hashes whose bits are counted at once.
SLICE = 1 << 14

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLOCKS = 8  # blocks of 4 bits in a half
_TILES = 5**_BLOCKS  # of a half: counts from 0 to 4 in each block
_FIVES = 5 ** np.arange(_BLOCKS, dtype=np.int64)
_COUNTS = np.array([(np.arange(1 << 16) >> (4 * k)) & 15 for k in range(4)])
#: For each 16 bits, the counts of its 4 blocks as digits to base 5.
_DIGITS = (np.bitwise_count(_COUNTS).astype(np.int64) * 5 ** np.arange(4)[:, None]).sum(0)


def fingerprint(text: bytes | None) -> int:
    words = text.translate(_LOWER).split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    hashed = xxhash.xxh64_intdigest
    for a in range(0, n, SLICE):
        runs = (b" ".join(words[k : k + SHINGLE]) for k in range(a, min(n, a + SLICE)))
        h = np.fromiter((hashed(r, SEED) for r in runs), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, print: the 64 bits as a long)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "print"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(made, "doc_id long, print long")


def tiles(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of (tile, whether a visitor, place in prints): at home in one tile of each half, on a visit in up to 8."""
    tile, visits, place = [], [], []
    everything = np.arange(len(prints))
    for half in range(2):
        low = ((prints >> np.uint64(32 * half)) & np.uint64(0xFFFF)).astype(np.int64)
        high = ((prints >> np.uint64(32 * half + 16)) & np.uint64(0xFFFF)).astype(np.int64)
        home = _DIGITS[low] + 625 * _DIGITS[high]
        tile.append(half * _TILES + home)
        visits.append(np.zeros(len(prints), bool))
        place.append(everything)
        for five in _FIVES:
            more = np.flatnonzero(home // five % 5 < 4)
            tile.append(half * _TILES + home[more] + five)
            visits.append(np.ones(len(more), bool))
            place.append(more)
    return np.concatenate(tile), np.concatenate(visits), np.concatenate(place)


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy().view(np.uint64)
        tile, visits, place = tiles(prints)
        yield pa.RecordBatch.from_arrays(
            [pa.array(tile.astype(np.int32)), pa.array(visits), pa.array(prints[place].view(np.int64))],
            names=["tile", "visits", "print"],
        )


class _Links:
    """The links of one tile that join what isn't joined yet."""

    def __init__(self, homes: np.ndarray) -> None:
        self.homes = homes[np.argsort(np.bitwise_count(homes), kind="stable")]
        self.counts = np.bitwise_count(self.homes).astype(np.int16)
        self.parent = np.arange(len(homes))
        self.found: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.parent
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def roots(self, span: slice) -> np.ndarray:
        return np.fromiter((self.root(x) for x in range(span.start, span.stop)), np.int64, span.stop - span.start)

    def joined(self, near: np.ndarray, a: slice, b: slice, left: np.ndarray, right: np.ndarray) -> None:
        """Take links among near (a boolean matrix of rows a and columns b of the parents) until none joins anything new."""
        while near.any():
            new = near & (self.roots(a)[:, None] != self.roots(b)[None, :])
            rows = np.flatnonzero(new.any(1))
            if not len(rows):
                return
            for i, j in zip(rows.tolist(), new[rows].argmax(1).tolist(), strict=True):
                x, y = self.root(a.start + i), self.root(b.start + j)
                if x != y:
                    self.parent[max(x, y)] = min(x, y)
                    self.found.append((int(left[i]), int(right[j])))

    def meet(self, others: np.ndarray) -> None:
        """Compare the homes with other fingerprints, which are sorted by their population count."""
        at = len(self.homes)
        self.parent = np.concatenate([self.parent[:at], np.arange(at, at + len(others))])
        counts = np.bitwise_count(others).astype(np.int16)
        for k in range(0, len(others), SIDE):
            y = others[k : k + SIDE]
            # homes whose population counts are within the radius of this tile's
            first = np.searchsorted(self.counts, counts[k] - RADIUS, "left")
            last = np.searchsorted(self.counts, counts[k : k + SIDE][-1] + RADIUS, "right")
            for j in range(first, last, SIDE):
                x = self.homes[j : min(last, j + SIDE)]
                near = np.bitwise_count(x[:, None] ^ y[None, :]) <= RADIUS
                self.joined(near, slice(j, j + len(x)), slice(at + k, at + k + len(y)), x, y)

    def among(self) -> None:
        n = len(self.homes)
        for j in range(0, n, SIDE):
            last = np.searchsorted(self.counts, self.counts[j : j + SIDE][-1] + RADIUS, "right")
            for k in range(j, last, SIDE):
                x, y = self.homes[j : j + SIDE], self.homes[k : min(last, k + SIDE)]
                near = np.bitwise_count(x[:, None] ^ y[None, :]) <= RADIUS
                self.joined(near, slice(j, j + len(x)), slice(k, k + len(y)), x, y)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (tile, part, visits) to links (a, b)."""
    tile: tuple[int, int] | None = None
    waiting: list[np.ndarray] = []  # homes of the tile, until its first visitor
    links: _Links | None = None

    def compared() -> _Links:
        made = _Links(np.concatenate(waiting))
        made.among()
        return made

    def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        found: list[tuple[int, int]] = []
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy().astype(np.int64)])
        visits = batch.column(2).to_numpy(zero_copy_only=False)
        prints = batch.column(3).to_numpy().view(np.uint64)
        edge = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0) | (visits[1:] != visits[:-1])) + 1
        cuts = [0, *edge.tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            here = (int(keys[0, a]), int(keys[1, a]))
            if here != tile:
                if waiting and links is None and sum(map(len, waiting)) > 1:
                    found += compared().found
                tile, waiting, links = here, [], None
            if not visits[a]:
                waiting.append(prints[a:b])
            elif waiting:
                links = links or compared()
                these = prints[a:b]
                links.meet(these[np.argsort(np.bitwise_count(these), kind="stable")])
                found += links.found
                links.found = []
        if found:
            yield out(found)
    if waiting and links is None and sum(map(len, waiting)) > 1:
        yield out(compared().found)


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that join all different fingerprints within the radius, directly or through others. prints: one column, distinct."""
    dealt = prints.mapInArrow(_dealt, "tile int, visits boolean, print long")
    # at most 2 * 5^8 tiles; those with more homes than a task holds are dealt out to `parts` tasks
    crowded = dealt.where("not visits").groupBy("tile").count().where(F.col("count") > MOST_HOMES)
    crowded = crowded.select("tile", F.ceil(F.col("count") / MOST_HOMES).cast("int").alias("parts"))
    dealt = dealt.join(F.broadcast(crowded), "tile", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("print"), F.col("parts")).cast("int")
    # homes of a crowded tile also visit its later parts, so that homes of two parts meet once
    at_home = F.transform(
        F.sequence(own, F.col("parts") - 1), lambda p: F.struct(p.alias("part"), (p > own).alias("visits"))
    )
    on_visit = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), F.lit(True).alias("visits")))
    rows = dealt.withColumn(
        "to",
        F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("part"), F.col("visits").alias("visits"))))
        .when(F.col("visits"), on_visit)
        .otherwise(at_home),
    ).select("tile", F.inline("to"), "print")
    rows = rows.repartition("tile", "part").sortWithinPartitions("tile", "part", "visits")
    return rows.mapInArrow(_linked, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of docs."""
    rows = stored(fingerprints(docs, id_col, text_col), "prints")
    vertices = stored(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "vertices")
    found = components(links(vertices.select("print")))
    vertices_in = vertices.join(found.withColumnRenamed("key", "print"), "print", "left")
    vertices_in = vertices_in.select("print", "least", F.coalesce("group", "print").alias("group"))
    named = vertices_in.groupBy("group").agg(F.min("least").alias("component_id"))
    named = stored(vertices_in.join(named, "group").select("print", "component_id"), "components")
    drop_stored(vertices)
    drop_stored(found)
    return rows.join(named, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )
