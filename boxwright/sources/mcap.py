"""MCAP recordings as a data source: messages of chunks, with the channels that a query asks for.

    spark.dataSource.register(McapSource)
    spark.read.format("mcap").option("topic", "/camera").load("/recordings/a.mcap")

A file's index is read from its end, where the footer tells its place; only in files without one are all records passed, without
reading their payloads. Every chunk is a partition, and chunks without a message of the wanted topic, or outside the wanted time
(options since_ns and until_ns, both inclusive), are never read. The data source reads the indexes one after the other;
recordings() has them as a distributed table, for many files. Paths are local or mounted files, as Python reads them; a file's chunks
are independent, so a lost task reads one chunk again. Chunks may be plain or compressed with zstd or lz4; other
compressions raise. Of several channels with the wanted topic the file's first is read. With the option schema_fields=true the
numbers of a protobuf message's fields, by the descriptors in the file, come with each message (null where there are none). With the option pushdown (which needs spark.sql.python.filterPushdown.enabled) the topic can also be a filter on
the column, and filters on log_time_ns leave out chunks. Messages keep their order by chunk_no and message_no.
"""

from __future__ import annotations

import glob
import pickle
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from boxwright.sources.protobuf import field_numbers, message_types

#: Fixed values of the format.
MAGIC = b"\x89MCAP0\r\n"
SCHEMA, CHANNEL, MESSAGE, CHUNK, CHUNK_INDEX, FOOTER = 0x03, 0x04, 0x05, 0x06, 0x08, 0x02

COLUMNS = (
    "path string, chunk_no int, message_no int, topic string, channel_id int, schema_name string, schema_encoding string, "
    "schema_fields map<string,int>, log_time_ns bigint, data binary"
)


class Cursor:
    """Reads little-endian values one after the other."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("a record is cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, code: str) -> int:
        return struct.unpack("<" + code, self.take(struct.calcsize("<" + code)))[0]

    def text(self) -> str:
        return self.take(self.number("I")).decode()

    def blob(self) -> bytes:
        return self.take(self.number("I"))

    def offsets(self) -> dict[int, int]:
        inner, out = Cursor(self.blob()), {}
        while inner.at < len(inner.data):
            channel = inner.number("H")
            out[channel] = inner.number("Q")
        return out


@dataclass
class Summary:
    """Schemas, channels and chunk places of a file."""

    path: str
    schemas: dict[int, tuple[str, str, bytes]] = field(default_factory=dict)
    channels: dict[int, tuple[int, str]] = field(default_factory=dict)
    chunks: list[tuple[int, dict[int, int], int, int]] = field(default_factory=list)  # place, channels, first and last time


def _index_records(f: BinaryIO, out: Summary) -> None:
    """Take the index records from here up to the footer; payloads of other records are skipped, not read."""
    while head := f.read(9):
        if len(head) < 9:
            raise ValueError(f"{out.path} is cut off")
        kind, size = head[0], struct.unpack("<Q", head[1:])[0]
        if kind == FOOTER:
            break
        if kind not in (SCHEMA, CHANNEL, CHUNK_INDEX):
            f.seek(size, 1)
            continue
        c = Cursor(f.read(size))
        if kind == SCHEMA:
            number, name, encoding = c.number("H"), c.text(), c.text()
            out.schemas[number] = (name, encoding, c.blob())
        elif kind == CHANNEL:
            number, schema = c.number("H"), c.number("H")
            out.channels[number] = (schema, c.text())
        else:
            first, last, start = c.number("Q"), c.number("Q"), c.number("Q")
            c.take(8)
            out.chunks.append((start, c.offsets(), first, last))


def read_summary(path: str) -> Summary:
    """The file's schemas, channels and chunks: those of its summary, or if it has none, of all its records."""
    with open(path, "rb") as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no MCAP file")
        end = 9 + 20 + len(MAGIC)  # the footer with its two places and a checksum
        if f.seek(0, 2) >= len(MAGIC) + end:
            f.seek(-end, 2)
            tail = Cursor(f.read(end))
            whole = tail.number("B") == FOOTER and tail.number("Q") == 20
            start = tail.number("Q") if whole else 0
            if start and tail.data.endswith(MAGIC):
                out = Summary(path)
                f.seek(start)
                _index_records(f, out)
                if out.channels and out.chunks:
                    return out
        f.seek(len(MAGIC))
        out = Summary(path)
        _index_records(f, out)
        return out


def read_chunk(path: str, start: int) -> bytes:
    """The records of the chunk at this place."""
    with open(path, "rb") as f:
        f.seek(start)
        head = f.read(9)
        if len(head) < 9 or head[0] != CHUNK:
            raise ValueError(f"{path} has no chunk at {start}")
        c = Cursor(f.read(struct.unpack("<Q", head[1:])[0]))
    c.take(16)
    size = c.number("Q")
    c.take(4)
    compression = c.text()
    data = c.take(c.number("Q"))
    if compression == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    if compression == "lz4":
        return pa.Codec("lz4").decompress(data, size, asbytes=True) if size else b""
    if compression:
        raise ValueError(f"chunks compressed with {compression} can't be read here")
    return data


def messages(records: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(channel, log time, payload) of the messages among a chunk's records."""
    c = Cursor(records)
    while c.at < len(records):
        kind = c.number("B")
        body = Cursor(c.take(c.number("Q")))
        if kind == MESSAGE:
            channel = body.number("H")
            body.take(4)
            time = body.number("Q")
            body.take(8)
            yield channel, time, body.data[body.at :]


@dataclass
class Chunk(InputPartition):
    path: str
    chunk_no: int
    start: int
    first_ns: int
    last_ns: int
    channels: dict[int, tuple[str, str, str, dict[str, int] | None]]


@dataclass
class Wanted:
    """What a query asks for; None for anything."""

    topic: str | None = None
    schema_name: str | None = None
    schema_fields: bool = False
    since: int | None = None
    until: int | None = None

    def has_time(self, first: int, last: int) -> bool:
        return (self.since is None or last >= self.since) and (self.until is None or first <= self.until)

    def chunks(self, path: str) -> list[Chunk]:
        """The chunks of a file that may have wanted messages. Times of 0 in an index are taken for unknown."""
        s = read_summary(path)
        wanted: dict[int, tuple[str, str, str, dict[str, int] | None]] = {}
        types = message_types(d for _, e, d in s.schemas.values() if e == "protobuf") if self.schema_fields else {}
        for number, (schema, topic) in s.channels.items():
            name, encoding, _ = s.schemas.get(schema, ("", "", b""))
            if self.topic is None or (topic == self.topic and not wanted):
                if self.schema_name not in (None, name):
                    raise ValueError(f"{topic} in {path} has the schema {name}")
                wanted[number] = (topic, name, encoding, field_numbers(types, name))
        if self.topic and not wanted:
            raise ValueError(f"{path} has no topic {self.topic}")
        return [
            Chunk(path, k, at, first, last, wanted)
            for k, (at, has, first, last) in enumerate(s.chunks)
            if (not has or has.keys() & wanted) and (not (first or last) or self.has_time(first, last))
        ]

    def rows(self, chunk: Chunk) -> Iterator[tuple]:
        """The chunk's wanted messages, as COLUMNS."""
        for k, (channel, time, data) in enumerate(messages(read_chunk(chunk.path, chunk.start))):
            if channel in chunk.channels and self.has_time(time, time):
                topic, name, encoding, fields = chunk.channels[channel]
                yield chunk.path, chunk.chunk_no, k, topic, channel, name, encoding, fields, time, data


_INDEX = "path string, chunk_no int, start long, first_ns long, last_ns long, channels binary"
_ARROW_COLUMNS = pa.schema(
    [("path", pa.string()), ("chunk_no", pa.int32()), ("message_no", pa.int32()), ("topic", pa.string()), ("channel_id", pa.int32()),
     ("schema_name", pa.string()), ("schema_encoding", pa.string()), ("schema_fields", pa.map_(pa.string(), pa.int32())),
     ("log_time_ns", pa.int64()), ("data", pa.binary())]
)


def chunk_index(files: DataFrame, wanted: Wanted) -> DataFrame:
    """A row for each chunk with wanted messages, read from the files' ends by many tasks. files: path, as list_files() gives it."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = wanted.chunks(path.removeprefix("file:"))
                columns = [[getattr(c, n) for c in found] for n in ("path", "chunk_no", "start", "first_ns", "last_ns")]
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                columns.append([pickle.dumps(c.channels) for c in found])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _INDEX.split(", ")])

    return files.select("path").repartition(4 * files.sparkSession.sparkContext.defaultParallelism, "path").mapInArrow(index, _INDEX)


def recordings(
    files: DataFrame, topic: str | None = None, since_ns: int | None = None, until_ns: int | None = None,
    schema_name: str | None = None, schema_fields: bool = False,
) -> DataFrame:
    """Messages of any number of files, as the data source has them, without a loop over files on the driver."""
    wanted = Wanted(topic, schema_name, schema_fields, since_ns, until_ns)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(*(row[n] for n in ("path", "chunk_no", "start", "first_ns", "last_ns")), pickle.loads(row["channels"]))
                if rows := list(wanted.rows(chunk)):
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([None if m is None else list(m.items()) for m in v] if f.name == "schema_fields" else v, f.type)
                         for v, f in zip(columns, _ARROW_COLUMNS, strict=True)], schema=_ARROW_COLUMNS,
                    )

    chunks = chunk_index(files, wanted).repartition("path", "chunk_no")
    return chunks.mapInArrow(read, COLUMNS)


class McapReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = sorted(p for x in options["path"].split(",") for p in glob.glob(x.removeprefix("file:")))
        if not self.paths:
            raise FileNotFoundError(options["path"])
        time = lambda name: int(options[name]) if options.get(name) else None
        self.wanted = Wanted(
            options.get("topic"), options.get("schema_name"), options.get("schema_fields") == "true", time("since_ns"), time("until_ns")
        )

    def partitions(self) -> list[Chunk]:
        return [c for path in self.paths for c in self.wanted.chunks(path)]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        return self.wanted.rows(partition)


class PushingMcapReader(McapReader):
    """Takes the topic from a filter, and bounds of the time."""

    def pushFilters(self, filters: list) -> Iterator:
        w = self.wanted
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("topic",) and w.topic in (None, f.value):
                w.topic = f.value
                continue
            if f.__class__ in (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual) and f.attribute == ("log_time_ns",):
                # bounds that are wide enough; Spark applies the filter itself too
                if not isinstance(f, LessThan | LessThanOrEqual):
                    w.since = f.value if w.since is None else max(w.since, f.value)
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    w.until = f.value if w.until is None else min(w.until, f.value)
            yield f


class McapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mcap"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> McapReader:
        return (PushingMcapReader if self.options.get("pushdown") == "true" else McapReader)(self.options)
