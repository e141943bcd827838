"""Running a detector over images: batches of pixels in, normalised detections out.

A detector is a class with `predict_batch(images) -> list of results` and `normalize(result, image) -> list of detections`:
dicts of category (or class_id, and class_name where the model emits one), confidence, and x1 to y2 in pixels. It is made once for
each task. What the raw boxes become, clipped boxes of the two categories in records, is done by column expressions.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.functions.geometry import clip, fields, not_degenerate
from boxwright.functions.names import CATEGORIES, canonical_category
from boxwright.functions.rounding import exact_round

PREDICTIONS = (
    "file_name string, detections array<struct<category:string,confidence:double,x1:double,y1:double,x2:double,y2:double>>, "
    "ms double"
)
RAW = PREDICTIONS.replace("category:string", "class_id:int,class_name:string")


class Detector(Protocol):
    def predict_batch(self, images: list[Any]) -> list[Any]: ...

    def normalize(self, result: Any, image: Any) -> list[dict[str, Any]]: ...


def predict(images: DataFrame, make: Callable[[], Detector], batch_size: int = 8, schema: str = PREDICTIONS) -> DataFrame:
    """file_name, detections and ms (time of its batch over the batch's images). images: file_name and content.

    schema: PREDICTIONS for detectors that name categories, RAW for those that give class ids. A task holds an Arrow batch of
    images at a time, so spark.sql.execution.arrow.maxRecordsPerBatch should be near the batch size.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = make()
        for batch in batches:
            out = []
            for a in range(0, len(batch), batch_size):
                part = batch.iloc[a : a + batch_size]
                contents = list(part["content"])
                began = time.perf_counter()
                results = detector.predict_batch(contents)
                ms = (time.perf_counter() - began) * 1000 / max(1, len(contents))
                if len(results) != len(contents):
                    raise ValueError(f"{len(results)} results for {len(contents)} images")
                for name, image, result in zip(part["file_name"], contents, results, strict=True):
                    out.append((name, detector.normalize(result, image), round(ms, 4)))
            yield pd.DataFrame(out, columns=["file_name", "detections", "ms"])

    return images.select("file_name", "content").mapInPandas(run, schema)


@dataclass(frozen=True)
class Model:
    """What the records say about a model, and what its class ids stand for."""

    name: str
    classes: Sequence[str]
    slots: dict[int, str | None] | None = None
    config: dict[str, Any] = field(default_factory=dict)
    checkpoint_sha256: str | None = None
    device: str = "cpu"
    floor: float = 0.005


def class_name(d: Column, model: Model) -> Column:
    """The name of a raw detection's class: by slot, else as emitted, else by number; null if it isn't wanted, raises if unknown."""
    unknown = F.raise_error(F.concat(F.lit("unknown class "), d["class_id"].cast("string")))
    if model.slots is not None:
        named = F.create_map(*[x for k, v in model.slots.items() for x in (F.lit(k), F.lit(v).cast("string"))])
        return F.when(F.map_contains_key(named, d["class_id"]), F.try_element_at(named, d["class_id"])).otherwise(unknown)
    listed = F.when(d["class_id"] >= 0, F.get(F.array(*map(F.lit, model.classes)), d["class_id"]))
    return F.coalesce(d["class_name"], listed, unknown)


def prediction_records(raw: DataFrame, images: DataFrame, model: Model) -> DataFrame:
    """A record for each image of `images`, with its raw detections (predict() with the schema RAW) clipped, named and rounded.

    images: file_name, split, width, height, source_recording, timestamp_seconds. Boxes without an extent in their image and
    classes that aren't wanted are left out; an image without a prediction raises. `ms` stays unrounded for the latencies.
    """
    rows = images.join(raw.withColumnRenamed("detections", "_raw"), "file_name", "left")
    there = F.when(F.col("_raw").isNull(), F.raise_error(F.concat(F.lit("no prediction for "), "file_name"))).otherwise(F.col("_raw"))
    named = F.transform(there, lambda d: F.struct(d.alias("d"), class_name(d, model).alias("name")))
    inside = lambda d: clip(fields(d), F.col("width"), F.col("height"))
    kept = F.filter(named, lambda e: e["name"].isNotNull() & not_degenerate(inside(e["d"])))
    number = lambda c: F.array_position(F.array(*map(F.lit, CATEGORIES)), c) - 1
    found = F.transform(
        kept,
        lambda e: F.struct(
            F.array(*[exact_round(v, 4) for v in inside(e["d"])]).alias("bbox_xyxy"),
            canonical_category(e["name"]).alias("category"), number(canonical_category(e["name"])).alias("category_id"),
            exact_round(e["d"]["confidence"], 6, plain=True).alias("confidence"), e["d"]["class_id"].alias("raw_class_id"),
            e["name"].alias("raw_class_name"),
        ),
    )
    return rows.select(
        "file_name", "split", "width", "height", "source_recording", "timestamp_seconds", F.lit(model.name).alias("model_name"),
        F.parse_json(F.lit(json.dumps(model.config, sort_keys=True))).alias("model_config"),
        F.lit(model.checkpoint_sha256).cast("string").alias("checkpoint_sha256"), F.lit(model.device).alias("device"),
        F.lit(model.floor).alias("inference_floor"), F.create_map(F.lit("inference"), exact_round(F.col("ms"), 4, plain=True)).alias("timing_ms"),
        found.alias("detections"), "ms",
    )
