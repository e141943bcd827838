"""Indexes of recordings read from their ends, and chunks left out by topic and time."""

import struct

from pyspark.sql import functions as F

from boxwright.sources import files, mcap
from test_core import record, text


def recording(path, chunks, summary=True):
    """A file with a topic /a in all chunks and /b in every second; a chunk has the times of its list, in seconds."""
    head = mcap.MAGIC + record(mcap.SCHEMA, struct.pack("<H", 1) + text("s") + text("json") + struct.pack("<I", 0))
    for channel, topic in ((1, "/a"), (2, "/b")):
        head += record(mcap.CHANNEL, struct.pack("<HH", channel, 1) + text(topic) + text("json") + struct.pack("<I", 0))
    out, index = head, head[len(mcap.MAGIC) :]
    for k, times in enumerate(chunks):
        inner, has = b"", [1, 2] if k % 2 else [1]
        for n, t in enumerate(times):
            for channel in has:
                inner += record(mcap.MESSAGE, struct.pack("<HIQQ", channel, n, t * 10**9, 0) + f"{channel} {t}".encode())
        body = struct.pack("<QQQI", 0, 0, len(inner), 0) + text("") + struct.pack("<Q", len(inner)) + inner
        offsets = b"".join(struct.pack("<HQ", c, 0) for c in has)
        first, last = min(times) * 10**9, max(times) * 10**9
        index += record(mcap.CHUNK_INDEX, struct.pack("<QQQQ", first, last, len(out), 0) + struct.pack("<I", len(offsets)) + offsets)
        out += record(mcap.CHUNK, body)
    footer = struct.pack("<QQI", len(out) if summary else 0, 0, 0)
    path.write_bytes(out + index + record(mcap.FOOTER, footer) + mcap.MAGIC)
    return str(path)


def test_index_from_the_end(tmp_path, monkeypatch):
    chunks = [[1, 2], [3], [4, 9]]
    a, b = (mcap.read_summary(recording(tmp_path / f"{k}.mcap", chunks, k)) for k in (True, False))
    assert (a.schemas, a.channels, a.chunks) == (b.schemas, b.channels, b.chunks) and len(a.chunks) == 3
    seen = []
    read = mcap._index_records
    monkeypatch.setattr(mcap, "_index_records", lambda f, out: (seen.append(f.tell()), read(f, out)))
    for name in ("True", "False"):
        mcap.read_summary(str(tmp_path / f"{name}.mcap"))
    assert seen[0] > 100 and seen[1] == len(mcap.MAGIC)  # from the summary's place; from the front


def test_many_recordings(spark, tmp_path):
    for k in range(7):
        recording(tmp_path / f"r{k}.mcap", [[100 * k + 1, 100 * k + 2], [100 * k + 3], [100 * k + 4, 100 * k + 9]], summary=k % 3 > 0)
    spark.dataSource.register(mcap.McapSource)
    source = spark.read.format("mcap").load(f"{tmp_path}/*.mcap")
    paths = files.list_files(spark, str(tmp_path), "*.mcap")
    rows = lambda df: sorted((r.path, r.chunk_no, r.message_no, r.topic, r.log_time_ns, bytes(r.data)) for r in df.collect())
    assert rows(mcap.recordings(paths)) == rows(source) and source.count() == 7 * 6
    assert rows(mcap.recordings(paths, "/b")) == rows(source.where("topic = '/b'"))
    # only chunks of the time are in the index, and only messages of the time are read
    since, until = 203 * 10**9, 302 * 10**9
    index = mcap.chunk_index(paths, mcap.Wanted(topic="/a", since=since, until=until)).collect()
    assert sorted((r.path[-7:], r.chunk_no) for r in index) == [("r2.mcap", 1), ("r2.mcap", 2), ("r3.mcap", 0)]
    some = mcap.recordings(paths, "/a", since, until)
    assert rows(some) == rows(source.where((F.col("topic") == "/a") & F.col("log_time_ns").between(since, until)))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = spark.read.format("mcap").option("pushdown", "true").load(f"{tmp_path}/*.mcap")
        pushed = pushed.where((F.col("topic") == "/a") & F.col("log_time_ns").between(since, until))
        assert rows(pushed) == rows(some) and pushed.rdd.getNumPartitions() == 3
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
