"""Commands: python -m boxwright.cli COMMAND --help."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from boxwright.functions.names import CATEGORIES
from boxwright.operators import dataset, revision, validate
from boxwright.plans import compare, prelabel
from boxwright.sources import files, sinks, video
from boxwright.sources.mcap import recordings


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="boxwright", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *options: str, **numbers: object) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for o in options:
            c.add_argument(f"--{o}", required=not o.endswith("?"), dest=o.rstrip("?")) if not o.endswith("?") else c.add_argument(f"--{o[:-1]}", dest=o[:-1])
        for n, default in numbers.items():
            c.add_argument(f"--{n}", type=type(default), default=default)
        return c

    add("compare-models", "dataset", "run", "output", "baseline", "candidate", overlap=0.5)
    add("compare-revisions", "old", "new", "output", unchanged=0.95, related=0.5)
    add("import-dataset", "archive", "target", "sha256?")
    add("export-yolo", "frames", "predictions", "images", "output").add_argument("--overwrite", action="store_true")
    add("read-videos", "recordings", "topic", "output")
    add("sample-frames", "videos", "output", fps=1.0)
    for name, inputs, least in (("predict-coco", ("dataset",), 0.005), ("predict-frames", ("images", "frames", "schema-dataset?"), 0.25)):
        c = add(name, *inputs, "detector", "checkpoint", "model", "output", confidence=least, batch=4, device="cpu")
        c.add_argument("--limit", type=int)
        if name == "predict-coco":
            c.add_argument("--split", default="all")
    return p


def main(argv: Sequence[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    if args.command == "import-dataset":
        print(files.import_archive(args.archive, args.target, args.sha256))
        return
    spark = SparkSession.builder.appName("boxwright").getOrCreate()
    if args.command == "compare-models":
        images, truth, found = compare.load(spark, args.dataset, args.run, (args.baseline, args.candidate))
        compare.write_reports(compare.compare(images, truth, found, args.baseline, args.candidate, least=args.overlap), args.output)
    elif args.command == "compare-revisions":
        sides = []
        for root in (args.old, args.new):
            loaded = [files.read_coco(spark, root, s)[:2] for s in compare.SPLITS]
            images, boxes = loaded[0]
            for i, b in loaded[1:]:
                images, boxes = images.unionByName(i), boxes.unionByName(b)
            validate.require_none(validate.key_clashes(images), f"images of one key in {root}")
            named = boxes.join(images.select("split", "image_id", "file_name"), ["split", "image_id"])
            sides.append(revision.revision_images(images, named, "file_name"))
        found = revision.changes(*sides, args.unchanged, args.related)
        sinks.write_jsonl(found, f"{args.output}/changes", "stable_image_key", "change_type")
        sinks.write_json(spark, {r["change_type"]: r["n"] for r in revision.summary(found).collect()}, f"{args.output}/summary.json")
    elif args.command == "export-yolo":
        frames = files.read_jsonl(spark, args.frames, files.FRAME)
        p = files.read_jsonl(spark, args.predictions, files.PREDICTION)
        listed = files.list_files(spark, args.images, "*")
        validate.require_none(validate.duplicates(p, "file_name"), "repeated predictions")
        validate.require_none(frames.join(p, "file_name", "left_anti").select("file_name"), "frames without predictions")
        validate.require_none(p.join(frames, "file_name", "left_anti").select("file_name"), "predictions without frames")
        # boxes are in pixels of the picture that the detector saw, so its record has the size
        sized = frames.drop("output_path", "width", "height").join(p.select("file_name", "width", "height"), "file_name")
        validate.require_none(validate.frame_violations(sized, listed), "frames")
        d = files.exploded_detections(p)
        below = F.col("confidence") < F.coalesce("confidence_threshold", "inference_floor")
        kept = d.where(~F.coalesce(below, F.lit(False)))
        lines = dataset.yolo_lines(kept.drop("width", "height"), sized, key="file_name")
        empty = frames.join(kept.select("file_name"), "file_name", "left_anti").select("file_name", F.lit(None).cast("int").alias("det_pos"), F.lit("").alias("line"))
        given = p.select("file_name", F.col("model_name").alias("prediction_model"), F.coalesce("confidence_threshold", "inference_floor").alias("prediction_threshold"), "checkpoint_sha256")
        about = frames.select("file_name", "source_mcap_path", "source_mcap_stem", "source_video", "timestamp_seconds").join(given, "file_name")
        lines = lines.select("file_name", "det_pos", "line").unionByName(empty)
        print(sinks.export_yolo(lines, about, args.images, args.output, CATEGORIES, args.overwrite))
    elif args.command == "read-videos":
        found = spark.read.format("binaryFile").load(args.recordings).select("path")
        messages = recordings(found, args.topic, schema_name=video.VIDEO_SCHEMA, schema_fields=True)
        rows = video.video_messages(messages)
        video.decodable_packets(rows).write.parquet(f"{args.output}/packets")
        sinks.write_jsonl(video.provenance(rows), f"{args.output}/videos", "path")
    elif args.command in ("predict-coco", "predict-frames"):
        options = {"confidence": args.confidence, "batch": args.batch, "device": args.device, "limit": args.limit}
        by = (args.detector, args.checkpoint, args.model)
        if args.command == "predict-coco":
            print(prelabel.predict_coco(spark, args.dataset, args.output, *by, args.split, **options))
        else:
            schema = getattr(args, "schema-dataset")
            print(prelabel.predict_frames(spark, args.images, args.frames, args.output, *by, schema, **options))
    else:
        validate.check_options(fps=args.fps)
        videos = spark.read.json(args.videos)
        sinks.write_jsonl(dataset.frame_records(dataset.sample_points(videos, args.fps)), args.output, "file_name")


if __name__ == "__main__":
    main()
