"""WARC archives: records of pages, written in segments, and read back by reassembly.

Writing: each page is an HTTP response with chunked transfer framing. A block longer than `segment_bytes` is split: the
first record has WARC-Segment-Number 1, and continuation records name it as their origin. Of equal payloads of at least
`least_bytes` the page with the smallest id is a response, the others are revisits that refer to it and have no
payload. The files are plain WARC 1.1 (gzip as a whole), made by Spark's own text writer with the blank lines between
records as separator, so any file system that Spark knows will do; files hold a bounded number of records.

Reading: files are parsed record by record by Content-Length. Continuation records are grouped by origin identifier,
ordered by segment number and joined; the total must be WARC-Segment-Total-Length and the numbers gapless. Then the
chunked framing is decoded. Records in one segment need no shuffle. Nothing is raised for a damaged record: `error`
says what is wrong with it, and its payload is null.

Null html is an empty payload, a null url has no target; a null page_id is the largest, and pages without an id never
share a response. If rows repeat the smallest page_id of a payload, all of them are responses, and revisits refer to one of
them. A page_id may also repeat with different payloads: a response is named by its page_id and its payload's digest, every other
record by its page_id and a random number, so identifiers never repeat and each reference is the name of a record. Long payloads are written in segments and
never cut. Other columns are ignored, whatever their names; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.llm.common import drop_stored, shared_folder, stored

SEGMENT_BYTES = 1 << 16
RECORDS_PER_FILE = 1000
CHUNK_BYTES = 1 << 13
#: Fixed values of the format.
SEPARATOR = b"\r\n\r\n"
VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a payload."""
    out = []
    for a in range(0, len(payload), size):
        part = payload[a : a + size]
        out += (b"%x\r\n" % len(part), part, b"\r\n")
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload in chunked framing; ValueError if the framing is damaged. Extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk without a size")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            if not body.endswith(b"\r\n"):
                raise ValueError("no end after the last chunk")
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(body[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends after its block."""
    lines = [f"{k}: {v}".encode() for k, v in headers if v is not None]
    return b"\r\n".join([VERSION, *lines, b"Content-Length: %d" % len(block), b"", block])


def response_name(page_id: int, sha: str) -> str:
    """The record identifier of the response with this payload; its revisits refer to it."""
    return f"<urn:page:{page_id}:{sha}>"


def page_records(
    page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, segment_bytes: int, named: bool = True
) -> Iterator[bytes]:
    """The records of one page. named: it is a response under the name that revisits refer to, of which there is one."""
    sha = base32_sha1(payload)
    page = f"page:{page_id}:" if page_id is not None else "uuid:"
    name = response_name(page_id, sha) if named and page_id is not None else f"<urn:{page}{uuid.uuid4()}>"
    target = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    digest = f"sha1:{sha}"
    common = [("WARC-Date", DATE), ("WARC-Target-URI", target)]
    if refers_to is not None:
        yield record(
            [("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, ("WARC-Payload-Digest", digest),
             ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", response_name(refers_to, sha)),
             ("Content-Type", "application/http; msgtype=response")], REVISIT_HEAD,
        )
        return
    block = HTTP_HEAD + chunked(payload)
    parts = [block[a : a + segment_bytes] for a in range(0, len(block), segment_bytes)]
    for k, part in enumerate(parts, 1):
        own = name if k == 1 else f"{name[:-1]}:{k}>"
        yield record(
            [("WARC-Type", "response" if k == 1 else "continuation"), ("WARC-Record-ID", own), *common,
             ("WARC-Payload-Digest", digest if k == 1 else None),
             ("WARC-Segment-Number", k if len(parts) > 1 else None),
             ("WARC-Segment-Origin-ID", name if k > 1 else None),
             ("WARC-Segment-Total-Length", len(block) if 1 < k == len(parts) else None),
             ("Content-Type", "application/http; msgtype=response" if k == 1 else None)], part,
        )


def write_archive(
    pages: DataFrame,
    path: str,
    least_bytes: int = 0,
    segment_bytes: int = SEGMENT_BYTES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> None:
    """Write the pages as WARC files into the folder `path`."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("sha", F.unhex(F.sha1("payload")))
    # Only payloads that occur more than once, each with its first page (equal rows count as `copies` of it). Sums of what each
    # task has seen, so a hot payload is one row for each.
    same = rows.where(F.length("payload") >= least_bytes).groupBy(F.col("sha").alias("_sha"), "page_id", "url").count()
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "count")))
    shared = same.groupBy("_sha").agg(least.alias("least"), F.sum("count").alias("n")).where("n > 1")
    shared = shared.select("_sha", F.col("least.page_id").alias("first"), F.col("least.url").alias("first_url"), F.col("least.count").alias("copies"))
    # as a table its size is known: it is sent to all tasks if it is small, else a hot payload can be split
    shared = stored(shared, "warc-shared")
    joined = rows.join(shared, F.col("sha") == F.col("_sha"), "left")
    long = F.length("payload") >= least_bytes
    refers = F.when(long & (F.col("page_id") != F.col("first")), F.col("first"))
    is_first = F.col("page_id").eqNullSafe(F.col("first")) & F.col("url").eqNullSafe(F.col("first_url"))
    named = long & (F.col("_sha").isNull() | (is_first & (F.col("copies") == 1)))
    joined = joined.select("page_id", "url", "payload", refers.alias("first"), named.alias("named"), (is_first & (F.col("copies") > 1)).alias("again"), "sha", "copies")
    if not shared.where("copies > 1").isEmpty():
        # equal rows that are the response: one of them has the name that revisits refer to
        again = joined.where("again").groupBy("page_id", "url", "sha", "copies").agg(F.first("payload").alias("payload"))
        again = again.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        again = again.select("page_id", "url", "payload", F.lit(None).cast("long").alias("first"), (F.col("k") == 1).alias("named"))
        joined = joined.where("again is null or not again").select(again.columns).unionByName(again)

    def to_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            size = 0
            columns = (batch.column(k).to_pylist() for k in range(5))
            for page_id, url, payload, first, named in zip(*columns, strict=True):
                made = [*page_records(page_id, url, payload, first, segment_bytes, bool(named))]
                out += made
                size += sum(map(len, made))
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    records = joined.select("page_id", "url", "payload", "first", "named").mapInArrow(to_records, "value binary")
    (
        records.select(F.col("value").cast("string"))
        .write.option("lineSep", SEPARATOR.decode())
        .option("compression", "gzip")
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )
    drop_stored(shared)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of the records in a file's bytes; ValueError at the first damaged one."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError("a record's head is cut off")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4
        at = start + int(headers["content-length"])
        if at > len(data):
            raise ValueError("a record's block is cut off")
        yield headers, data[start:at]
        if data[at : at + 4] == SEPARATOR:
            at += 4


_PARSED = (
    "record_id string, record_type string, target string, digest string, refers_to string, origin string, "
    "segment int, total long, block binary, error string"
)
_READ = (
    "record_id string, record_type string, target string, digest string, refers_to string, payload binary, "
    "error string"
)


def _parse_files(batches: Iterator[pa.RecordBatch], segmented: bool) -> Iterator[pa.RecordBatch]:
    """The records of archive files: those in several segments, or the others (and what is damaged)."""
    schema = pa.schema(
        [(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in
         (x.split() for x in _PARSED.split(", "))]
    )
    for batch in batches:
        for content in batch.column(0):
            data = content.as_py()
            if data[:2] == b"\x1f\x8b":
                parts = []
                while data:
                    d = zlib.decompressobj(31)
                    parts.append(d.decompress(data))
                    data = d.unused_data
                data = b"".join(parts)
            rows: list[tuple] = []
            size = 0
            try:
                for h, block in parse(data):
                    number = h.get("warc-segment-number")
                    origin = h.get("warc-segment-origin-id") or (h.get("warc-record-id") if number else None)
                    if segmented == (origin is None):
                        continue
                    total = h.get("warc-segment-total-length")
                    rows.append(
                        (h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"),
                         (h.get("warc-payload-digest") or "").partition(":")[2] or None, h.get("warc-refers-to"),
                         origin, int(number) if number else None, int(total) if total else None, block, None)
                    )
                    size += len(block)
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, size = [], 0
            except (ValueError, KeyError) as e:
                if not segmented:
                    rows.append((None, None, None, None, None, None, None, None, None, f"damaged file: {e}"))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema
                )


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From whole blocks (an error, or null) to payloads."""
    for batch in batches:
        payloads, errors = [], []
        columns = (batch.column(n).to_pylist() for n in ("record_type", "digest", "block", "error"))
        for kind, digest, block, error in zip(*columns, strict=True):
            payload = None
            if error is None and kind == "response":
                block = b"".join(block) if isinstance(block, list) else block  # of segments, in order
                head, sep, body = block.partition(b"\r\n\r\n")
                try:
                    if not sep:
                        raise ValueError("no HTTP head")
                    coded = b"transfer-encoding: chunked" in head.lower()
                    payload = dechunked(body) if coded else body
                    if digest and base32_sha1(payload) != digest:
                        payload, error = None, "the payload differs from its digest"
                except ValueError as e:
                    error = str(e)
            payloads.append(payload)
            errors.append(error)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in ("record_id", "record_type", "target", "digest", "refers_to")),
             pa.array(payloads, pa.binary()), pa.array(errors, pa.string())],
            names=["record_id", "record_type", "target", "digest", "refers_to", "payload", "error"],
        )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, target, digest, refers_to, payload, error: a row for each record, reassembled."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    whole = files.mapInArrow(lambda it: _decode(_parse_files(it, segmented=False)), _READ)
    parts = (
        files.mapInArrow(lambda it: _parse_files(it, segmented=True), _PARSED)
        .groupBy("origin")
        .agg(
            F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
            *[
                F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
                for c in ("record_id", "record_type", "target", "digest", "refers_to")
            ],
            F.max("total").alias("total"),
        )
        .withColumn("block", F.transform("parts", lambda p: p["block"]))
        .withColumn("length", F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.length(p["block"])))
    )
    gapless = F.transform("parts", lambda p: p["segment"]) == F.sequence(F.lit(1), F.size("parts"))
    parts = parts.withColumn(
        "error",
        F.when(F.col("record_id").isNull(), "a continuation without its origin")
        .when(~gapless, "segments are missing or repeated")
        .when(F.col("total").isNull(), "no last segment")
        .when(F.col("length") != F.col("total"), "the length differs from the total"),
    )
    columns = ["record_id", "record_type", "target", "digest", "refers_to", "block", "error"]
    return whole.unionByName(parts.select(columns).mapInArrow(_decode, _READ))


def page_number(name: Column) -> Column:
    """The page id in a record's identifier; null if it has none."""
    return F.nullif(F.regexp_extract(name, "^<urn:page:(-?[0-9]+)", 1), F.lit("")).cast("long")


def archived_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages to a new archive in the shared folder and read it back; a row for each page.

    page_id, payload_bytes, payload_digest, record_type, refers_to, error. A revisit's payload_bytes are those of the
    response that it refers to, found in the archive.
    """
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/boxwright-warc-{uuid.uuid4().hex}"
    write_archive(pages, path, least_bytes)
    read = read_archive(spark, path).select(
        "record_id",
        page_number(F.col("record_id")).alias("page_id"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        F.col("refers_to").alias("refers_to_id"),
        page_number(F.col("refers_to")).alias("refers_to"),
        "error",
    )
    read = stored(read, "warc-read")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error"]
    revisits = read.where("refers_to_id is not null")
    # the responses that revisits refer to by their identifiers, each of which is one record's
    wanted = revisits.select(F.col("refers_to_id").alias("_id")).distinct()
    responses = read.where("record_type = 'response' and payload_bytes is not null")
    responses = responses.select(F.col("record_id").alias("_id"), F.col("payload_bytes").alias("_n")).join(wanted, "_id", "left_semi")
    responses = stored(responses, "warc-responses")
    found = revisits.join(responses, F.col("refers_to_id") == F.col("_id"), "left").select(
        "page_id", F.col("_n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to",
        F.when(F.col("_n").isNull(), "its response is missing").otherwise(F.col("error")).alias("error"),
    )
    return read.where("refers_to_id is null").select(columns).unionByName(found)
