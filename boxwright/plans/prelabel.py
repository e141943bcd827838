"""Running a detector over a dataset's splits or over sampled frames, and writing its records and latencies.

A detector comes as a module with two functions:

    describe(checkpoint) -> {"class_names": [...], "slots": n or absent, "config": {...}}
    make(checkpoint, confidence, device) -> an operators.inference.Detector

describe() runs on the driver, make() in each task. Images are read by Spark's binary source, so they may lie on any file
system that Spark knows, and never shuffle: only the boxes found are joined to the images' sizes.
"""

from __future__ import annotations

import importlib
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.functions.names import CATEGORIES, check_ordered_classes, recording_id, timestamp_seconds
from boxwright.operators import dataset, inference, validate
from boxwright.plans.compare import SPLITS
from boxwright.sources import files, sinks

#: Image files by their endings.
IMAGES = "*.{jpg,jpeg,png,JPG,JPEG,PNG}"


def split_names(name: str) -> tuple[str, ...]:
    """All splits for `all`, else the one named."""
    if name != "all" and name not in SPLITS:
        raise ValueError(f"the split must be all or one of {', '.join(SPLITS)}")
    return SPLITS if name == "all" else (name,)


def image_contents(spark: SparkSession, folder: str, names: Sequence[str] | None = None) -> DataFrame:
    """file_name (below the folder) and content of a folder's images, or of those named. Files without a byte give no row."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")
    if names is not None:
        read = spark.read.format("binaryFile").load([f"{root}/{n}" for n in names])
    else:
        read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", IMAGES).load(root)
    # one spelling of local roots: file:/a and file:///a
    below = F.expr(f"substring(regexp_replace(path, '^file:/+', 'file:/'), {len(root) + 2})")
    return read.select(below.alias("file_name"), "content")


def slots_of(spark: SparkSession, root: str, split: str, about: dict) -> dict[int, str | None] | None:
    """What a detector's slots stand for in a split; null if it doesn't say how many it has. Reads a row for each category."""
    if about.get("slots") is None:
        return None
    _, annotations, categories = files.read_coco(spark, root, split)
    used = annotations.select("category_id").distinct()
    known = [(r["category_id"], r["category"]) for r in categories.collect()]
    empty = {r["category_id"] for r in categories.join(used, "category_id", "left_anti").collect()}
    ignored = [i for i, name in known if i in empty and name not in CATEGORIES]
    return dataset.class_slots(known, about["class_names"], about["slots"], ignored)


def run(
    spark: SparkSession,
    images: DataFrame,
    folder: str,
    detector: str,
    checkpoint: str,
    name: str,
    output: str,
    latency: str,
    slots: dict[int, str | None] | None = None,
    confidence: float = 0.005,
    device: str = "cpu",
    batch: int = 4,
    limit: int | None = None,
    image: str = "file_name",
) -> dict[str, int]:
    """Records of `images` (see inference.prediction_records()) as JSON lines, their latencies as JSON; the totals.

    image: the column with the image's place below the folder. limit: only the first images by name.
    """
    validate.check_share("the confidence", confidence)
    validate.check_options(batch=batch, limit=limit)
    if not files.exists(spark, checkpoint):
        raise ValueError(f"there is no checkpoint {checkpoint}")
    module = importlib.import_module(detector)
    about = module.describe(checkpoint)
    classes = about["class_names"]
    check_ordered_classes(classes)
    names = None
    if limit is not None:
        images = images.orderBy("file_name").limit(limit)
        names = [r[0] for r in images.select(image).collect()]  # at most `limit` names
    config = {"checkpoint": checkpoint.rsplit("/", 1)[-1], "class_names": list(classes), **about.get("config", {})}
    if slots is not None:
        config["class_slot_mapping"] = {str(k): v for k, v in slots.items()}
    digest = files.file_digests(spark, checkpoint).first()["sha256"]
    model = inference.Model(name, classes, slots, config, digest, device, confidence)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    raw = inference.predict(image_contents(spark, folder, names), lambda: module.make(checkpoint, confidence, device), batch, inference.RAW)
    if image != "file_name":
        raw = raw.withColumnRenamed("file_name", image).join(images.select(image, "file_name"), image).drop(image)
    # the detector runs once for the records and the latencies
    records = inference.prediction_records(raw, images, model).persist(StorageLevel.DISK_ONLY)
    try:
        sinks.write_jsonl(records.drop("ms"), output, "file_name")
        times = {r["split"]: r for r in dataset.latency_summary(records, ["split"], "ms").collect()}
        boxes = {r["split"]: r["n"] for r in records.groupBy("split").agg(F.sum(F.size("detections")).alias("n")).collect()}
    finally:
        records.unpersist()
    for split, t in times.items():
        per_image = {k: round(t[f"{k}_ms"], 4) for k in ("mean", "median", "p90", "min", "max")}
        about_it = {"model_name": name, "split": split, "device": device, "checkpoint_sha256": digest, "model_config": config}
        counts = {"image_count": t["images"], "detection_count": boxes[split]}
        sinks.write_json(spark, about_it | counts | {"per_image_inference_ms": per_image}, latency)
    return {"images": sum(t["images"] for t in times.values()), "detections": sum(boxes.values())}


def predict_coco(spark: SparkSession, root: str, output: str, detector: str, checkpoint: str, name: str, split: str = "all", **options) -> dict[str, dict[str, int]]:
    """Records of a dataset's splits: predictions/NAME/SPLIT.jsonl and latency/NAME/SPLIT.json below the output folder."""
    about = importlib.import_module(detector).describe(checkpoint)
    chosen = split_names(split)
    slots = [slots_of(spark, root, s, about) for s in chosen]
    if any(x != slots[0] for x in slots):
        raise ValueError("the splits' categories give the detector's slots different meanings")
    out = {}
    for s in chosen:
        images, _, _ = files.read_coco(spark, root, s)
        validate.require_none(validate.image_size_violations(images), f"images of {s} without a size")
        rows = images.select(
            "file_name", "split", "width", "height", recording_id(F.col("file_name")).alias("source_recording"),
            timestamp_seconds(F.col("file_name")).alias("timestamp_seconds"),
        )
        out[s] = run(spark, rows, f"{root}/{s}", detector, checkpoint, name, f"{output}/predictions/{name}/{s}.jsonl", f"{output}/latency/{name}/{s}.json", slots[0], **options)
    return out


def predict_frames(spark: SparkSession, folder: str, frames: str, output: str, detector: str, checkpoint: str, name: str, schema_root: str | None = None, **options) -> dict[str, int]:
    """Records of sampled frames, for pre-labelling: OUTPUT.jsonl and OUTPUT.latency.json.

    schema_root: the dataset whose `train` categories tell what a detector's slots stand for.
    """
    records = files.read_jsonl(spark, frames, files.FRAME)
    if records.isEmpty():
        raise ValueError(f"{frames} has no frame records")
    listed = files.list_files(spark, folder, IMAGES)
    validate.require_none(validate.frame_violations(records, listed), "frames")
    slots = slots_of(spark, schema_root, "train", importlib.import_module(detector).describe(checkpoint)) if schema_root else None
    rows = records.select(
        "file_name", F.lit("frames").alias("split"), "width", "height", F.col("source_mcap_stem").alias("source_recording"),
        "timestamp_seconds", F.coalesce("output_path", "file_name").alias("_image"),
    )
    return run(spark, rows, folder, detector, checkpoint, name, f"{output}.jsonl", f"{output}.latency.json", slots, image="_image", **options)
