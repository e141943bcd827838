"""Benchmark decontamination by a distributed positional inverted index.

The corpus is indexed once: each task tokenises whole texts and writes segments, tables of a bounded number of words,
with all words of their documents: a local dictionary, and for each word its postings, the sorted places where it
occurs. Segments share nothing, so the index is spread over the cluster like the documents and needs no shuffle.

A search takes test items in blocks of at most BLOCK_WORDS windows, longer items in several pieces. In each segment a phrase starts from the postings of its rarest
word; the lists of its other words, offset by their place in the phrase, are intersected with them, rarest first, for
all phrases at once. A phrase with a word that the segment lacks ends at once. Proximity matches are stretches of at
most length + slop words that hold every word of a phrase in any order. A document's matches are gathered within its
segment; only if there are several blocks of items are the blocks' findings merged by document.

A segment ends at SEGMENT_WORDS words but never splits a document, so memory is bounded by that and by the longest
text. Null and empty texts and items have no words; null and repeated ids are rows like any other, and so are repeated rows;
repeated items count once by their id, a null id as an empty one. Every row of the documents gives a row; without items none
has a match, without documents there is no row. Of either table only the id and the text are read, whatever its other columns.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm.common import stored, words_of

SEGMENT_WORDS = 1 << 20
#: Words of a window; shorter items are one window of all their words.
WINDOW = 10
#: Words of test items that one search takes to the executors.
BLOCK_WORDS = 1 << 19
#: Words that may stand between those of a window in a proximity match.
SLOP = 3

SEGMENT = (
    "segment string, doc_ids array<long>, doc_starts binary, words binary, word_ends binary, "
    "post_starts binary, places binary"
)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From batches of (doc_id, text) to segments."""
    import uuid

    def fresh() -> tuple[list, list, list, defaultdict]:
        return [], [0], [], defaultdict(count().__next__)

    def segment() -> pa.RecordBatch:
        words = list(known)
        of = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        order = np.argsort(of, kind="stable").astype(np.int32)
        starts = np.searchsorted(of[order], np.arange(len(words) + 1)).astype(np.int32)
        ends = np.cumsum([len(w) for w in words], dtype=np.int32) if words else np.zeros(0, np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([uuid.uuid4().hex]),
                pa.array([doc_ids], pa.list_(pa.int64())),
                pa.array([np.array(doc_starts, np.int32).tobytes()]),
                pa.array([b"".join(words)]),
                pa.array([ends.tobytes()]),
                pa.array([starts.tobytes()]),
                pa.array([order.tobytes()]),
            ],
            names=["segment", "doc_ids", "doc_starts", "words", "word_ends", "post_starts", "places"],
        )

    doc_ids, doc_starts, ids, known = fresh()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = words_of(text.as_py())
            ids.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
            doc_ids.append(doc_id)
            doc_starts.append(doc_starts[-1] + len(words))
            if doc_starts[-1] >= SEGMENT_WORDS:
                yield segment()
                doc_ids, doc_starts, ids, known = fresh()
    if doc_ids:
        yield segment()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of docs as a table in the shared folder; it can serve any number of searches."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return stored(rows.mapInArrow(_segments, SEGMENT), "phrase-index")


class Segment:
    """A segment in memory. Places count the words of all its documents one after the other."""

    def __init__(self, row: dict) -> None:
        self.doc_ids = row["doc_ids"]
        self.doc_starts = np.frombuffer(row["doc_starts"], np.int32)
        self.post_starts = np.frombuffer(row["post_starts"], np.int32)
        self.places = np.frombuffer(row["places"], np.int32)
        ends = np.frombuffer(row["word_ends"], np.int32).tolist()
        text = row["words"]
        self.ids = {text[a:b]: k for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False))}
        # postings of all words in one sorted array: word * span + place
        self.span = int(self.doc_starts[-1]) + 1
        of = np.repeat(np.arange(len(self.post_starts) - 1, dtype=np.int64), np.diff(self.post_starts))
        self.keys = of * self.span + self.places

    def holds(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Is the place in the word's postings?"""
        want = word.astype(np.int64) * self.span + place
        at = np.searchsorted(self.keys, want)
        return (place >= 0) & (place < self.span) & (self.keys[np.minimum(at, len(self.keys) - 1)] == want)

    def next_place(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The word's first place from there on; a far one if there is none."""
        at = np.searchsorted(self.keys, word.astype(np.int64) * self.span + np.maximum(place, 0))
        key = self.keys[np.minimum(at, len(self.keys) - 1)]
        there = (at < len(self.keys)) & (key // self.span == word)
        return np.where(there, key % self.span, np.int64(1) << 40)

    def same_doc(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Do the places start and end - 1 lie in one document?"""
        doc = np.searchsorted(self.doc_starts, start, "right")
        return end <= self.doc_starts[np.minimum(doc, len(self.doc_starts) - 1)]

    def known(self, vocabulary: list[bytes], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those rows of a matrix of words of which the segment has all, and their words' local ids (-1: no word)."""
        get = self.ids.get
        local = np.array([*(get(w, -1) for w in vocabulary), -1], np.int64)
        ids = local[matrix]
        which = np.flatnonzero(((ids >= 0) | (matrix < 0)).all(1))
        return which, ids[which]

    def rarest(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Local ids and offsets of the windows' words, rarest first."""
        often = np.where(word >= 0, np.diff(self.post_starts)[word], np.iinfo(np.int32).max)
        order = np.argsort(often, axis=1, kind="stable")
        return np.take_along_axis(word, order, 1), order

    def seeds(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each of these words' postings: the word's row, and the place."""
        a, n = self.post_starts[word], self.post_starts[word + 1] - self.post_starts[word]
        row = np.repeat(np.arange(len(word)), n)
        place = self.places[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)]
        return row, place.astype(np.int64)

    def phrases(self, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exact matches: window, first place, place after the last."""
        which, ids = self.known(windows.vocabulary, windows.words)
        if not len(which):
            return (np.zeros(0, np.int64),) * 3
        n = (ids >= 0).sum(1)
        word, offset = self.rarest(ids)
        row, place = self.seeds(word[:, 0])
        start = place - offset[row, 0]
        for k in range(1, word.shape[1]):
            w = word[row, k]
            ok = w < 0
            ok[~ok] = self.holds(w[~ok], (start + offset[row, k])[~ok])
            row, start = row[ok], start[ok]
        ok = (start >= 0) & self.same_doc(start, start + n[row])
        row, start = row[ok], start[ok]
        return which[row], start, start + n[row]

    def near(self, windows: Windows, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Proximity matches: window, first place, place after the last of the shortest stretch from there on."""
        which, ids = self.known(windows.vocabulary, windows.different)
        if not len(which):
            return (np.zeros(0, np.int64),) * 3
        word, _ = self.rarest(ids)
        width = windows.lengths[which] + slop
        row, place = self.seeds(word[:, 0])
        # a stretch around the rarest word's place needs all other words within its width of that place
        for k in range(1, word.shape[1]):
            w = word[row, k]
            there = self.next_place(np.maximum(w, 0), place - width[row] + 1)
            ok = (w < 0) | (there < place + width[row])
            row, place = row[ok], place[ok]
        out = []
        for back in range(int(width.max())):
            # stretches that begin `back` words before the rarest word's place
            fits = (back < width[row]) & (place - back >= 0)
            r, start = row[fits], place[fits] - back
            end, begins = np.zeros(len(r), np.int64), np.zeros(len(r), bool)
            for k in range(word.shape[1]):
                w = word[r, k]
                there = self.next_place(np.maximum(w, 0), start)
                end = np.where(w >= 0, np.maximum(end, there + 1), end)
                begins |= (w >= 0) & (there == start)
            ok = begins & (end - start <= width[r])
            ok[ok] &= self.same_doc(start[ok], end[ok])
            out.append(np.stack([r[ok], start[ok], end[ok]]))
        r, start, end = np.unique(np.concatenate(out, 1), axis=1)
        return which[r], start, end


class Windows:
    """Windows as rows of numbers of their different words, padded with -1."""

    def __init__(self, windows: list[tuple[bytes, ...]]) -> None:
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.words = np.full((len(windows), max([1, *map(len, windows)])), -1, np.int32)
        self.different = self.words.copy()  # each word once
        for k, w in enumerate(windows):
            self.words[k, : len(w)] = [number[x] for x in w]
            once = dict.fromkeys(w)
            self.different[k, : len(once)] = [number[x] for x in once]
        self.vocabulary = list(number)
        self.lengths = np.array([len(w) for w in windows], np.int64)


def windows_of(words: list[bytes]) -> list[tuple[bytes, ...]]:
    """All runs of WINDOW words; of fewer words, but not none, all of them."""
    if len(words) < WINDOW:
        return [tuple(words)] if words else []
    return [tuple(words[k : k + WINDOW]) for k in range(len(words) - WINDOW + 1)]


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items' words in blocks of at most about BLOCK_WORDS; a longer item in pieces that share its windows out."""
    block, n = [], 0
    for row in items.toLocalIterator():
        words = words_of(row["text"])
        for a in range(0, max(1, len(words) - WINDOW + 1), BLOCK_WORDS):
            piece = words[a : a + BLOCK_WORDS + WINDOW - 1]
            if block and n + len(piece) > BLOCK_WORDS:
                yield block
                block, n = [], 0
            if piece:
                block.append((row["item_id"], piece))
                n += len(piece)
    yield block


def search(
    index: DataFrame,
    items: DataFrame,
    slop: int | None = None,
    item_col: str = "item_id",
    text_col: str = "text",
) -> DataFrame:
    """A row for each document of the index, with what it shares with the items.

    doc_id, n_words; n_hit (words inside an exact match), spans (first word and number of words of each stretch of hit
    words), items (ids of items with a match, as sorted strings); with slop, n_near, near_spans and near_items, the same of
    proximity matches, which exact ones are too.
    """
    spark = index.sparkSession
    items = items.select(F.col(item_col).cast("string").alias("item_id"), F.col(text_col).cast("binary").alias("text"))
    kinds = [_KINDS[0]] if slop is None else _KINDS
    schema = ", ".join(["segment string, place int, doc_id long, n_words long", *(_FIELDS.format(*k) for k in kinds)])
    found = []
    for block in _blocks(items):
        owners: dict[tuple[bytes, ...], list[str]] = defaultdict(list)
        for item, words in block:
            for w in set(windows_of(words)):
                owners[w].append("" if item is None else item)
        shared = spark.sparkContext.broadcast((Windows(list(owners)), list(owners.values())))  # at most BLOCK_WORDS windows

        def look(batches: Iterator[pa.RecordBatch], shared=shared, slop=slop) -> Iterator[pa.RecordBatch]:
            windows, item_lists = shared.value
            for batch in batches:
                for row in batch.to_pylist():
                    s = Segment(row)
                    n = len(s.doc_ids)
                    out = {
                        "segment": pa.array([row["segment"]] * n),
                        "place": pa.array(np.arange(n, dtype=np.int32)),
                        "doc_id": pa.array(s.doc_ids, pa.int64()),
                        "n_words": pa.array(np.diff(s.doc_starts).astype(np.int64)),
                    }
                    out |= zip(_KINDS[0], _found(s, *s.phrases(windows), item_lists), strict=True)
                    if slop is not None:
                        out |= zip(_KINDS[1], _found(s, *s.near(windows, slop), item_lists), strict=True)
                    yield pa.RecordBatch.from_pydict(out)

        found.append(index.mapInArrow(look, schema))
    if len(found) == 1:
        return found[0].drop("segment", "place")
    # the blocks' findings of a document meet: at most a few for each block that has a match in it
    rows = reduce(DataFrame.unionByName, found)
    merged = rows.groupBy("segment", "place").agg(
        F.first("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        *[
            made.alias(name)
            for n, spans, ids in kinds
            for name, made in (
                (n, F.max(n)), (spans, F.array_sort(F.flatten(F.collect_list(spans)))),
                (ids, F.array_sort(F.array_distinct(F.flatten(F.collect_list(ids))))),
            )
        ],
    ).drop("segment", "place")
    return merged.mapInArrow(lambda it: _merge_spans(it, kinds), merged.schema)


#: Columns of exact and of proximity matches.
_KINDS = [("n_hit", "spans", "items"), ("n_near", "near_spans", "near_items")]
_FIELDS = "{} long, {} array<struct<start:int,length:int>>, {} array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))


def _found(
    s: Segment, which: np.ndarray, start: np.ndarray, end: np.ndarray, item_lists: list[list[str]]
) -> tuple[pa.Array, pa.Array, pa.Array]:
    """For each document of a segment the number of words inside matches, their stretches and the items."""
    edge = np.zeros(s.span + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    hit = np.cumsum(edge[: s.span - 1]) > 0
    doc = np.searchsorted(s.doc_starts, start, "right") - 1
    items: dict[int, set[str]] = defaultdict(set)
    for d, w in set(zip(doc.tolist(), which.tolist(), strict=True)):
        items[d].update(item_lists[w])
    n = len(s.doc_ids)
    sums = np.concatenate([[0], np.cumsum(hit)])
    n_hit = sums[s.doc_starts[1:]] - sums[s.doc_starts[:-1]]
    spans: list[list[dict]] = [[] for _ in range(n)]
    for d in items:
        a, b = s.doc_starts[d], s.doc_starts[d + 1]
        turn = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]])))
        spans[d] = [{"start": x, "length": y - x} for x, y in turn.reshape(-1, 2).tolist()]
    ids = pa.array([sorted(items.get(d, ())) for d in range(n)], pa.list_(pa.string()))
    return pa.array(n_hit.astype(np.int64)), pa.array(spans, _SPANS), ids


def _merge_spans(batches: Iterator[pa.RecordBatch], kinds: list[tuple[str, str, str]]) -> Iterator[pa.RecordBatch]:
    """Stretches of several blocks, sorted, become stretches that don't overlap, and their words are counted anew."""
    for batch in batches:
        made = {n: batch.column(n) for n in batch.schema.names}
        for n, spans, _ in kinds:
            n_hit, merged = [], []
            for found in batch.column(spans).to_pylist():
                out: list[list[int]] = []
                for x in found:
                    a, b = x["start"], x["start"] + x["length"]
                    if out and a <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], b)
                    else:
                        out.append([a, b])
                n_hit.append(sum(b - a for a, b in out))
                merged.append([{"start": a, "length": b - a} for a, b in out])
            made |= {n: pa.array(n_hit, pa.int64()), spans: pa.array(merged, _SPANS)}
        yield pa.RecordBatch.from_pydict(made)


def digest(found: DataFrame) -> DataFrame:
    """search()'s rows with the items as a number and a digest, and whether the document is contaminated.

    If the search had a slop, also n_near (words inside a proximity match) and n_near_items.
    """
    near = ["n_near", F.size("near_items").cast("long").alias("n_near_items")] if "n_near" in found.columns else []
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        *near,
    )


def items_digest(items: list[str]) -> str:
    """What digest() gives for these items."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
