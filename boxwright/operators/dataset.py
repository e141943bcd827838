"""Datasets: ground-truth boxes, split summaries, pages of images, detections, frame samples, latencies and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxwright.functions.geometry import clip, corners, not_degenerate
from boxwright.functions.media import yolo_label
from boxwright.functions.names import CATEGORIES, check_ordered_classes, frame_file_name, recording_id, stable_image_key, timestamp_seconds
from boxwright.functions.rounding import exact_round
from boxwright.operators.order import Pages, keyed, order_statistics, same

DEFAULT_FPS = 30.0


def ground_truth_boxes(annotations: DataFrame, images: DataFrame, key: str = "image_id") -> DataFrame:
    """Annotations with the names and splits of their images."""
    return annotations.join(images.select(key, "split", "file_name"), key)


def image_provenance(images: DataFrame) -> DataFrame:
    """Each image's stable key, recording and time."""
    name = F.col("file_name")
    return images.select(
        "file_name", stable_image_key(name).alias("image_key"), recording_id(name).alias("recording"),
        timestamp_seconds(name).alias("timestamp_seconds"),
    )


def split_summary(images: DataFrame, boxes: DataFrame, key: str = "image_id") -> DataFrame:
    """Images, annotations, negatives, recordings and annotations of each category, for each split."""
    counts = boxes.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES]
    )
    rows = images.join(counts, key, "left").fillna(0, ["n", *CATEGORIES])
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("images"), F.sum("n").alias("annotations"), F.count_if(F.col("n") == 0).alias("negatives"),
        F.countDistinct(recording_id(F.col("file_name"))).alias("recordings"),
        *[F.sum(c).alias(f"{c}_annotations") for c in CATEGORIES],
    )


def paged_images(images: DataFrame, start: int, limit: int) -> DataFrame:
    """Images by name, from a place on, a page of them. Several pages of the same images: order.Pages."""
    return Pages(images, "file_name").page(start, limit)


def normalized_detections(raw: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """Detections clipped to their image, those without an extent left out; confidence to six places, corners to four."""
    x1, y1, x2, y2 = clip(corners(), F.col(width), F.col(height))
    rows = raw.withColumns({"x1": x1, "y1": y1, "x2": x2, "y2": y2}).where(not_degenerate(corners()))
    return rows.withColumns(
        {c: exact_round(F.col(c), 4, plain=True) for c in ("x1", "y1", "x2", "y2")}
        | {"confidence": exact_round(F.col("confidence"), 6, plain=True)}
    )


def resolve_classes(raw: DataFrame, explicit: DataFrame | None = None, names: Sequence[str] = ()) -> DataFrame:
    """Add `category` to raw class ids: an explicit map first, then names that the model emits, then its list of names.

    Classes mapped to null or to the background are left out; an unknown class raises.
    """
    rows = raw
    if explicit is not None:
        # a model's classes: a handful of rows
        mapped = explicit.select(F.col("class_id"), F.col("category").alias("_mapped"), F.lit(True).alias("_known"))
        rows = rows.join(F.broadcast(mapped), "class_id", "left")
    else:
        rows = rows.withColumns({"_mapped": F.lit(None).cast("string"), "_known": F.lit(False)})
    emitted = F.col("class_name") if "class_name" in raw.columns else F.lit(None).cast("string")
    listed = F.get(F.array(*map(F.lit, names)), F.col("class_id")) if names else F.lit(None).cast("string")
    known = F.coalesce("_known", F.lit(False))
    category = F.when(known, F.col("_mapped")).otherwise(F.coalesce(emitted, listed))
    unknown = ~known & category.isNull()
    category = F.when(unknown, F.raise_error(F.concat(F.lit("unknown class "), F.col("class_id").cast("string")))).otherwise(category)
    rows = rows.withColumn("category", category).where("category is not null and category <> '__background__'")
    return rows.drop("_mapped", "_known")


def class_slots(categories: Sequence[tuple[int, str]], class_names: Sequence[str], n_slots: int, ignored: Sequence[int] = ()) -> dict[int, str | None]:
    """What each slot of a detector's output stands for: a category's name, or null for one that isn't wanted.

    A dataset with ignored categories has a slot for each category in the order of ids, if the numbers agree, and the others
    must be left, then right. Otherwise the detector's own class names come first and the background follows.
    """
    ordered = sorted(categories)
    if ignored and n_slots == len(ordered):
        slots = {k: None if i in ignored else name for k, (i, name) in enumerate(ordered)}
        check_ordered_classes([name for name in slots.values() if name is not None])
        return slots
    if n_slots > 0 and n_slots == len(class_names) + 1:
        return {**dict(enumerate(class_names)), len(class_names): None}
    raise ValueError(f"{n_slots} slots fit neither {len(ordered)} categories nor {len(class_names)} classes")


def query_count(rows: int, groups: int) -> int:
    """Queries of a detector whose table has `rows` rows for `groups` training groups."""
    if rows <= 0 or groups <= 0 or rows % groups:
        raise ValueError(f"{rows} rows can't be divided into {groups} groups")
    return rows // groups


def sample_points(videos: DataFrame, fps: float) -> DataFrame:
    """Frames to take from each video at this rate: frame_index and timestamp_seconds.

    videos: duration_seconds, fps and frame_count (null if unknown).
    """
    n = F.greatest(F.lit(1), F.ceil(F.col("duration_seconds") * fps)).cast("int")
    rows = videos.withColumn("_k", F.explode(F.sequence(F.lit(0), n - 1)))
    rows = rows.withColumn("_t", F.col("_k") / F.lit(float(fps)))
    rows = rows.withColumn("frame_index", F.floor(F.col("_t") * F.col("fps")))
    inside = (F.col("_t") < F.col("duration_seconds")) & (
        F.col("frame_count").isNull() | (F.col("frame_index") < F.col("frame_count"))
    )
    return rows.where(inside).withColumn("timestamp_seconds", F.col("frame_index") / F.col("fps")).drop("_k", "_t")


def frame_records(points: DataFrame) -> DataFrame:
    """sample_points() with the names of the frames' files. Needs `stem`, the recording's name."""
    return points.withColumn("file_name", frame_file_name(F.col("stem"), F.col("frame_index"), F.col("timestamp_seconds")))


def estimated_fps(messages: DataFrame, by: str, time_ns: str, order: Sequence[str] | None = None) -> DataFrame:
    """For each recording the rate of the median positive distance of neighbouring messages; a default without any."""
    after = Window.partitionBy(by).orderBy(*(order or [time_ns]))
    delta = messages.withColumn("_d", F.col(time_ns) - F.lag(time_ns).over(after))
    middle = keyed(order_statistics(delta.where("_d > 0"), [by], "_d", [0.5]), [by])
    names = messages.select(by).distinct()
    return names.join(middle, same(names, middle, [by]), "left").select(by, F.coalesce(1e9 / F.col("q0"), F.lit(DEFAULT_FPS)).alias("fps"))


def gop_gate(packets: DataFrame, by: str, order: Sequence[str], sps: str = "has_sps", params_only: str = "params_only", idr: str = "has_idr") -> DataFrame:
    """Packets that can be decoded: all from the first key frame on that has parameter sets in it or before it.

    If that key frame lacks its own, the packets of parameter sets alone before it are kept too: `in_front` marks them.
    """
    before = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    until = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    from_here = Window.partitionBy(by).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    seen = F.coalesce(F.max(F.col(params_only)).over(before), F.lit(False))
    rows = packets.withColumn("_start", F.col(idr) & (F.col(sps) | seen))
    rows = rows.withColumn("_open", F.max("_start").over(until))
    first = F.first(F.when(F.col("_start"), F.col(sps)), ignorenulls=True).over(from_here)
    rows = rows.withColumn("in_front", ~F.col("_open") & F.col(params_only) & (first == F.lit(False)))
    return rows.where(F.col("_open") | F.col("in_front")).drop("_start", "_open")


def latency_summary(times: DataFrame, by: Sequence[str], value: str = "ms") -> DataFrame:
    """Mean, median, ninth decile, least and largest time; zeros for no time."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    whole = times.groupBy(*by).agg(
        F.count(value).alias("images"), zero(F.avg(value)).alias("mean_ms"), zero(F.min(value)).alias("min_ms"), zero(F.max(value)).alias("max_ms")
    )
    middle = keyed(order_statistics(times, by, value, [0.5, 0.9]), by)
    rows = whole.join(middle, same(whole, middle, by), "left")
    return rows.select(*by, "images", "mean_ms", zero(F.col("q0")).alias("median_ms"), zero(F.col("q1")).alias("p90_ms"), "min_ms", "max_ms")


def yolo_lines(boxes: DataFrame, images: DataFrame, categories: Sequence[str] = CATEGORIES, key: str = "image_id") -> DataFrame:
    """A label line for each box; null `line` for a box that has no extent in its image."""
    number = F.array_position(F.array(*map(F.lit, categories)), F.col("category")) - 1
    rows = boxes.join(images.select(key, "file_name", "width", "height"), key)
    return rows.withColumn("line", yolo_label(number, corners(), F.col("width"), F.col("height")))


def export_manifest(images: DataFrame, detections: DataFrame, key: str = "image_id") -> DataFrame:
    """A row for each exported image: its detections of at least the export's threshold.

    The threshold of an image's predictions is `confidence_threshold`, or `inference_floor` where that is null.
    """
    least = F.coalesce("confidence_threshold", "inference_floor")
    kept = detections.where(F.col("confidence") >= least)
    counts = kept.groupBy(key).agg(F.count(F.lit(1)).alias("detections"))
    rows = images.join(counts, key, "left").fillna(0, ["detections"])
    return rows.select(
        "file_name", recording_id(F.col("file_name")).alias("source_recording"), "detections",
        (F.col("detections") == 0).alias("empty_label"),
    )


def export_totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(
        F.count(F.lit(1)).alias("images"), F.coalesce(F.sum("detections"), F.lit(0)).alias("detections"),
        F.count_if("empty_label").alias("empty_labels"),
    )


def upsert(existing: DataFrame, found: DataFrame, *by: str) -> DataFrame:
    """Existing records, and the found ones whose key isn't among them (an incremental run)."""
    return existing.unionByName(found.join(existing.select(*by), list(by), "left_anti"), allowMissingColumns=True)


def first_by(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key: the first channel of a topic, the first frame id of a recording."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_n", place).where("_n = 1").drop("_n")
