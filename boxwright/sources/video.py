"""Compressed-video messages: fields of their protobuf payload, packets that can be decoded, provenance rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.functions.media import message_seconds, nal_types_of
from boxwright.operators.dataset import estimated_fps, gop_gate
from boxwright.sources.protobuf import protobuf_fields

VIDEO_SCHEMA = "foxglove.CompressedVideo"
#: Unit types of H.264.
IDR, SPS, PPS = 5, 7, 8
#: Field numbers of the public schema, for recordings without descriptors.
PUBLIC_NUMBERS = {"timestamp": 1, "timestamp.seconds": 1, "timestamp.nanos": 2, "frame_id": 2, "data": 3, "format": 4}
FIELDS = "seconds bigint, nanos bigint, frame_id string, packet binary, format string, nal array<int>"


def video_fields(data: bytes, numbers: dict[str, int] = PUBLIC_NUMBERS) -> tuple[int, int, str, bytes, str]:
    """Time, frame id, packet and format of a compressed-video message, whose fields have these numbers."""
    found = dict(protobuf_fields(data))
    time = dict(protobuf_fields(found.get(numbers["timestamp"], b"")))
    part = lambda name: bytes(found.get(numbers[name], b""))
    seconds, nanos = (int(time.get(numbers.get(f"timestamp.{n}", PUBLIC_NUMBERS[f"timestamp.{n}"]), 0)) for n in ("seconds", "nanos"))
    return seconds, nanos, part("frame_id").decode(), part("data"), part("format").decode()


def video_messages(messages: DataFrame) -> DataFrame:
    """Messages with their decoded fields, time, and what their packets hold.

    Field numbers are those of the recording's descriptors (the source's option schema_fields), else the public ones.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [video_fields(bytes(x), dict(n) if n else PUBLIC_NUMBERS) for x, n in zip(b["data"], b["schema_fields"], strict=True)]
            out = b[["path", "chunk_no", "message_no", "log_time_ns"]].copy()
            for k, n in enumerate(("seconds", "nanos", "frame_id", "packet", "format")):
                out[n] = [m[k] for m in made]
            out["nal"] = [sorted(nal_types_of(m[3])) for m in made]
            yield out

    rows = messages.mapInPandas(run, "path string, chunk_no int, message_no int, log_time_ns bigint, " + FIELDS)
    has = lambda n: F.array_contains("nal", n)
    params = F.array(F.lit(SPS), F.lit(PPS))
    return rows.withColumns(
        {
            "time": message_seconds(F.col("seconds"), F.col("nanos"), F.col("log_time_ns")),
            "has_idr": has(IDR),
            "has_sps": has(SPS),
            "params_only": (F.size("nal") > 0) & (F.size(F.array_except("nal", params)) == 0),
        }
    )


def decodable_packets(video: DataFrame) -> DataFrame:
    """The packets of each recording from its first complete key frame on, with parameter sets in front if it has none."""
    return gop_gate(video, "path", ["chunk_no", "message_no"])


def provenance(video: DataFrame) -> DataFrame:
    """frame_id, format, frame_count, time range and rate of each recording's packets.

    frame_id is the first that isn't empty, format that of the same packet; without a frame_id the last packet's format.
    """
    order = F.struct("chunk_no", "message_no")
    kept = decodable_packets(video).where("not in_front")
    named = F.min_by(F.struct("frame_id", "format"), F.when(F.col("frame_id") != "", order))
    kind = F.when(named.isNotNull(), named["format"]).otherwise(F.max_by("format", order))
    rows = kept.groupBy("path").agg(
        named["frame_id"].alias("frame_id"), F.coalesce(F.nullif(kind, F.lit("")), F.lit("unknown")).alias("format"),
        F.count(F.lit(1)).alias("frame_count"), F.array(F.min("time"), F.max("time")).alias("time_range_sec"),
    )
    fps = estimated_fps(kept, "path", "log_time_ns", ["chunk_no", "message_no"])
    return rows.join(fps.withColumnRenamed("fps", "average_fps"), "path")
