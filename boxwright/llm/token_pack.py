"""Token-ID output: texts as ids, packed best-fit-decreasing into rows of a fixed length.

Each task tokenises whole texts and packs them in shards of a bounded number of tokens. A text longer than a row is
split into full rows and a rest, without loss. Pieces are placed from long to short, each into the open row with the
least room that still holds it; a segment tree over the rooms finds that row in log2(row length) steps, whatever the
number of rows. A shard is written as one record: the id matrix (16 or 32 bits an id, row after row, padded), the
cumulative segment lengths of all rows one after the other (padding is a segment of its own, without a document), and
for each segment its document, the place of its first token in the document, and where positions start again from 0
(at each segment). Nothing is shuffled, and a shard is read back alone.

Tokenisers are the public ones named in the parameters, or "bytes" (an id for each byte). Null and empty texts have no
tokens and no segment, but stay in the shard's list of documents. doc_ids may be null or repeat, and repeated rows are packed as
often as they occur; pieces of one length are placed in their order. Very long texts are split, never cut: a shard ends after the
text that fills it, so memory is bounded by SHARD_TOKENS and the longest text. An empty table gives no shard. Only the id and
the text are read, whatever the other columns are called. The named tokenisers come with the installed package
`public_tokenizers`, which executors need too, or from `path`.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm.common import stored

ROW_TOKENS = 2048
SHARD_TOKENS = 1 << 21
#: Texts where a blank stands before white space or at an end are cut at other places than blanks.
_ODD_BLANKS = r"^ | $| [\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class Rooms:
    """Open rows by the room they have left: a segment tree over rooms 0 to capacity, each leaf a stack of rows."""

    def __init__(self, capacity: int) -> None:
        self.base = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = self.base + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Room and row of the open row with the least room of at least `size`, which is taken out; or None."""
        count, node = self.count, self.base + size
        if not count[node]:
            # up to the first subtree on the right that has a row, then down to its leftmost
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.base:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.base
        row = self.rows[room].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return room, row


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers: pieces from long to short (ties in order), each where the least room holds it."""
    rooms, rows = Rooms(capacity), []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = rooms.take(lengths[k])
        room, row = found or (capacity, len(rows))
        if found is None:
            rows.append([])
        rows[row].append(k)
        rooms.add(room - lengths[k], row)
    return rows


def byte_bpe(path: str, pattern: str):
    """A function from an array of texts to (token ids as 16-bit little-endian bytes, offsets of the texts in bytes).

    The vocabulary is byte-level BPE in the file's ranks. Texts are cut before blanks, where the pattern cuts too; each
    different part is encoded once a batch, in native code as all else.
    """
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> bytes:
        return np.array(encoding.encode_ordinary(text), np.uint16).tobytes()

    def encode(texts: pa.Array) -> tuple[bytes, np.ndarray]:
        odd = pc.match_substring_regex(texts, _ODD_BLANKS)
        plain = pc.if_else(odd, "", texts)
        parts = pc.split_pattern(plain, " ")
        offsets = parts.offsets.to_numpy()
        first = np.zeros(len(parts.flatten()), bool)
        first[offsets[:-1]] = True
        coded = parts.flatten().dictionary_encode()
        words, code = coded.dictionary, coded.indices.to_numpy()
        # a part is encoded with the blank before it, but for the first of a text
        code = code + np.where(first, len(words), 0)
        used = np.unique(code)
        texts_of = words.to_pylist()
        one = encoding._core_bpe.encode_ordinary
        made = [one(texts_of[k - len(words)] if k >= len(words) else " " + texts_of[k]) for k in used.tolist()]
        flat = np.fromiter((x for m in made for x in m), np.uint16, sum(map(len, made)))
        ends = np.concatenate([[0], np.cumsum([2 * len(m) for m in made])]).astype(np.int32)
        values = pa.Array.from_buffers(pa.binary(), len(made), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
        place = np.searchsorted(used, code)
        taken = values.take(pa.array(place))
        starts = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1)
        data, at = taken.buffers()[2].to_pybytes() if taken.buffers()[2] else b"", starts[offsets]
        if pc.any(odd).as_py():
            where = set(np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist())
            pieces = [
                ids(texts[k].as_py()) if k in where else data[at[k] : at[k + 1]] for k in range(len(texts))
            ]
            data, at = b"".join(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        return data, at

    return encode, 2


def plain_bytes():
    """An id for each byte of the UTF-8 text, as 16-bit numbers."""

    def encode(texts: pa.Array) -> tuple[bytes, np.ndarray]:
        raw = [t.as_py().encode() for t in texts]
        at = np.concatenate([[0], 2 * np.cumsum([len(r) for r in raw])]).astype(np.int64)
        return np.frombuffer(b"".join(raw), np.uint8).astype(np.uint16).tobytes(), at

    return encode, 2


def tokenizer(name: str, path: str | None):
    if name == "bytes":
        return plain_bytes()
    import public_tokenizers

    return byte_bpe(path or public_tokenizers.path(name), public_tokenizers.PATTERN)


PACKED = (
    "shard string, row_tokens int, n_rows int, id_bytes int, pad_id int, ids binary, cu_seqlens binary, "
    "position_resets binary, seg_doc binary, seg_start binary, doc_ids array<long>, doc_tokens binary"
)


def _pack(doc_ids: list, ids: list[bytes], width: int, row: int, pad: int) -> pa.RecordBatch:
    """One shard of these documents."""
    lengths, owner, start = [], [], []
    for d, x in enumerate(ids):
        n = len(x) // width
        for a in range(0, n, row):
            lengths.append(min(row, n - a))
            owner.append(d)
            start.append(a)
    rows = best_fit_decreasing(lengths, row)
    padding = pad.to_bytes(width, "little")
    out, seg_len, seg_doc, seg_start, resets = [], [], [], [], []
    for r, pieces in enumerate(rows):
        used = 0
        for k in pieces:
            d, a, n = owner[k], start[k], lengths[k]
            out.append(ids[d][a * width : (a + n) * width])
            seg_len.append(n)
            seg_doc.append(d)
            seg_start.append(a)
            resets.append(r * row + used)
            used += n
        if used < row:
            out.append(padding * (row - used))
            seg_len.append(row - used)
            seg_doc.append(-1)
            seg_start.append(0)
            resets.append(r * row + used)
    as_bytes = lambda x, t=np.int32: np.array(x, t).tobytes()
    matrix = b"".join(out)
    name = hashlib.sha1(matrix + as_bytes([0 if d is None else d for d in doc_ids], np.int64)).hexdigest()
    values = [
        name, row, len(rows), width, pad, matrix, as_bytes(np.concatenate([[0], np.cumsum(seg_len)])),
        as_bytes(resets), as_bytes(seg_doc), as_bytes(seg_start), doc_ids, as_bytes([len(x) // width for x in ids]),
    ]
    types = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split(" ") for f in PACKED.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array([v], types[t]) for v, (_, t) in zip(values, fields, strict=True)], names=[n for n, _ in fields]
    )


def pack(
    docs: DataFrame,
    name: str = "byte_bpe_50k.tiktoken",
    path: str | None = None,
    row_tokens: int = ROW_TOKENS,
    shard_tokens: int = SHARD_TOKENS,
    pad_id: int = 50256,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The packed shards of docs; see the module's docstring. Write them to Parquet as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, width = tokenizer(name, path)
        doc_ids: list = []
        ids: list[bytes] = []
        n = 0
        for whole in batches:
            for a in range(0, whole.num_rows, 2000):
                batch = whole.slice(a, 2000)
                texts = pc.fill_null(batch.column(1), "")
                data, at = encode(texts)
                for k, d in enumerate(batch.column(0).to_pylist()):
                    x = data[at[k] : at[k + 1]]
                    doc_ids.append(d)
                    ids.append(x)
                    n += len(x) // width
                    if n >= shard_tokens:
                        yield _pack(doc_ids, ids, width, row_tokens, pad_id)
                        doc_ids, ids, n = [], [], 0
        if doc_ids:
            yield _pack(doc_ids, ids, width, row_tokens, pad_id)

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, PACKED)


UNPACKED = "shard string, doc_id long, n_tokens long, n_pieces long, n_rows long, ids_sha256 string, whole boolean"


def unpack(row: dict) -> Iterator[tuple[object, bytes, list[int], list[int]]]:
    """From a shard's record: each document with its ids in order, its pieces' lengths and their rows."""
    read = lambda k: np.frombuffer(row[k], np.int32).tolist()
    edge, owner, start, tokens = read("cu_seqlens"), read("seg_doc"), read("seg_start"), read("doc_tokens")
    width, per_row, matrix = row["id_bytes"], row["row_tokens"], row["ids"]
    pieces: list[list[tuple[int, int, int]]] = [[] for _ in tokens]
    for k, d in enumerate(owner):
        if d >= 0:
            pieces[d].append((start[k], edge[k], edge[k + 1]))
    for d, found in enumerate(pieces):
        found.sort()
        ids = b"".join(matrix[a * width : b * width] for _, a, b in found)
        yield row["doc_ids"][d], ids, [b - a for _, a, b in found], [a // per_row for _, a, _ in found]


def read_back(packed: DataFrame) -> DataFrame:
    """For each document of packed shards: tokens, pieces, rows, the digest of its ids, and if all tokens are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                expected = np.frombuffer(row["doc_tokens"], np.int32).tolist()
                out = [
                    (row["shard"], d, len(ids) // row["id_bytes"], len(lens), len(set(rows)),
                     hashlib.sha256(ids).hexdigest(), len(ids) // row["id_bytes"] == n)
                    for (d, ids, lens, rows), n in zip(unpack(row), expected, strict=True)
                ]
                types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                    names=[f.split(" ")[0] for f in UNPACKED.split(", ")],
                )

    return packed.mapInArrow(run, UNPACKED)


def packed_documents(docs: DataFrame, **options) -> DataFrame:
    """Pack docs into a table in the shared folder and read every document back."""
    return read_back(stored(pack(docs, **options), "packed"))
