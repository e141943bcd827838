"""Comparing two models on a dataset: operating points from one split, metrics and errors on all, reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.functions.names import canonical_category, recording_id
from boxwright.operators import evaluation, review, validate
from boxwright.operators.average_precision import average_precision
from boxwright.operators.crowds import match_any
from boxwright.sources import sinks
from boxwright.sources.files import exploded_detections, read_coco, read_predictions
from boxwright.sources.json_split import qualified
from boxwright.sources.scratch import cut

SPLITS = ("train", "valid", "test")
MOST_ON_PAGE = 500


@dataclass
class Comparison:
    """What a comparison finds; all but the thresholds are lazy."""

    thresholds: dict[str, float]
    sweep: DataFrame
    selection: DataFrame
    metrics: DataFrame
    deltas: DataFrame
    diagnostics: DataFrame
    images: DataFrame
    matches: DataFrame
    errors: DataFrame


def load(spark: SparkSession, root: str, run: str, models: Sequence[str], splits: Sequence[str] = SPLITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, ground truth, predictions) of all splits, validated. Boxes are keyed by file name."""
    images = truth = found = listed = there = None
    union = lambda a, b: b if a is None else a.unionByName(b)
    for split in splits:
        i, a, c = read_coco(spark, root, split)
        images, truth = union(images, i), union(truth, a)
        listed = union(listed, c.select(F.lit(split).alias("split"), "category"))
        there = union(there, files_of_split(spark, root, split))
        for model in models:
            p = read_predictions(spark, run, model, split).withColumns({"split": F.lit(split), "_model": F.lit(model)})
            found = union(found, p)
    # read once, used by all rules and by the comparison
    images, truth, found = (cut(df) for df in (images, truth, found))
    rules = [
        (validate.duplicates(images, "split", "image_id"), "repeated image ids"),
        (validate.duplicates(images, "split", "file_name"), "repeated file names"),
        (validate.image_size_violations(images), "images without a size"),
        (images.where(recording_id(F.col("file_name")).isNull()).select("split", "file_name"), "names without a recording"),
        (validate.duplicates(truth, "split", "annotation_id"), "repeated annotation ids"),
        (validate.category_violations(truth, listed), "categories"),
        (images.select("split", "file_name").join(there, ["split", "file_name"], "left_anti"), "missing images"),
        (boxes_of_splits(truth, images), "boxes"),
        (found.where(~F.col("model_name").eqNullSafe(F.col("_model"))).select("split", "_model", "model_name"), "model names"),
        (validate.duplicates(found, "split", "_model", "file_name"), "repeated predictions"),
        (coverage(images, found, models), "predictions that don't fit the images"),
    ]
    for violations, what in rules:
        validate.require_none(violations, what)
    truth = truth.withColumn("category", canonical_category(F.col("category")))
    truth = truth.join(images.select("split", "image_id", "file_name"), ["split", "image_id"])
    found = exploded_detections(found)
    validate.require_none(validate.recording_leakage(images), "recordings in several splits")
    return images, truth, found.withColumn("category", canonical_category(F.col("category")))


def files_of_split(spark: SparkSession, root: str, split: str) -> DataFrame:
    """split, file_name: the files in a split's folder and below, named from there. Files without a byte aren't listed by Spark."""
    folder = qualified(spark, f"{root}/{split}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    inside = F.substring_index("path", f"{folder.partition(':')[2].rstrip('/')}/", -1)
    return files.select(F.lit(split).alias("split"), inside.alias("file_name"))


def boxes_of_splits(truth: DataFrame, images: DataFrame) -> DataFrame:
    """validate.bbox_violations() for several splits, whose image ids may be the same."""
    key = F.struct("split", "image_id").alias("key")
    return validate.bbox_violations(truth.withColumn("key", key), images.withColumn("key", key), "key")


def coverage(images: DataFrame, found: DataFrame, models: Sequence[str]) -> DataFrame:
    """split, file_name, model: images without a model's predictions, and predictions without an image."""
    every = images.select("split", "file_name", F.explode(F.array(*map(F.lit, models))).alias("model"))
    there = found.select("split", "file_name", F.col("_model").alias("model"))
    by = ["split", "file_name", "model"]
    return every.join(there, by, "left_anti").unionByName(there.join(every, by, "left_anti"))


def compare(
    images: DataFrame,
    truth: DataFrame,
    found: DataFrame,
    baseline: str,
    candidate: str,
    select_on: str = "valid",
    least: float = 0.5,
    key: str = "file_name",
) -> Comparison:
    """Each model at the threshold with the best overall F2 on the split `select_on`."""
    validate.check_share("the overlap", least)
    models = (baseline, candidate)
    sweep = cut(evaluation.threshold_sweep(images, truth, found, models, least, key, match_any))
    selection = evaluation.select_thresholds(sweep)
    at = selection.where((F.col("split") == select_on) & (F.col("category") == evaluation.MICRO))
    thresholds = {r["model_name"]: r["f2_threshold"] for r in at.collect()}  # a row for each model
    ap = average_precision(images, truth, found, models, key)
    metrics = matches = None
    # each model's matches are found once, and serve its metric rows, the image manifest and the errors
    for model in models:
        own = found.where(F.col("model_name") == model)
        found_ = cut(match_any(truth, own, [model], thresholds[model], least, key))
        rows = evaluation.evaluation_rows(images, truth, own, [model], thresholds[model], least, ap, key, found_)
        metrics = rows if metrics is None else metrics.unionByName(rows)
        matches = found_ if matches is None else matches.unionByName(found_)
    metrics = cut(metrics)
    return Comparison(
        thresholds, sweep, selection, metrics, evaluation.metric_deltas(metrics, baseline, candidate),
        evaluation.diagnostic_aggregates(metrics), review.image_manifest(images, matches, models, key), matches,
        review.error_manifest(images, matches, baseline, candidate, key),
    )


def write_reports(c: Comparison, path: str, images_at: str = "images") -> None:
    """Tables as CSV, JSON lines and Markdown, charts as SVG, and a page of images with errors for each split.

    images_at: where the pages look for images. What the driver holds are metric rows, points at distinct confidences, and
    for the pages the names of images with errors, MOST_ON_PAGE of a page at once.
    """
    spark = c.metrics.sparkSession
    write = lambda text, name: sinks.write_text(spark, text, f"{path}/{name}")
    sinks.write_csv_file([c.sweep], f"{path}/curves.csv", "split", "model_name", "category", "threshold")
    sinks.write_csv_file([c.selection], f"{path}/selection.csv", "split", "model_name", "category")
    sinks.write_csv_file([c.metrics], f"{path}/metrics.csv", "split", "model_name", "category")
    sinks.write_csv_file([c.deltas], f"{path}/deltas.csv", "split", "category")
    sinks.write_csv_file([c.diagnostics], f"{path}/diagnostics.csv", "model_name", "category", "aggregation")
    sinks.write_jsonl_file(c.images, f"{path}/images.jsonl", "file_name", "model_name")
    sinks.write_jsonl_file(c.errors, f"{path}/errors.jsonl", "split", "file_name", "model_name")
    rows = [r.asDict() for r in c.metrics.orderBy("split", "model_name", "category").collect()]
    whole = ["tp", "fp", "fn", "confusions"]
    write("# Metrics\n\n" + sinks.markdown_table(rows, ["split", "model_name", "category", "confidence_threshold", *evaluation.METRICS, *whole]), "metrics.md")
    deltas = [r.asDict() for r in c.deltas.orderBy("split", "category").collect()]
    gains = [f"{m}_absolute_delta" for m in evaluation.METRICS]
    write("# Gain of the candidate\n\n" + sinks.markdown_table(deltas, ["split", "category", *gains], gains), "deltas.md")
    sinks.write_json(spark, {"thresholds": c.thresholds, "images": c.images.select("file_name").distinct().count()}, f"{path}/comparison.json")
    points = evaluation.pr_curve_points(c.sweep).orderBy(F.desc("threshold")).collect()
    for split, category in sorted({(p["split"], p["category"]) for p in points}):
        own = [p for p in points if (p["split"], p["category"]) == (split, category)]
        line = lambda model, a, b: [(p[a], p[b]) for p in own if p["model_name"] == model]  # noqa: B023, E731
        series = {m: line(m, "recall", "precision") for m in sorted(c.thresholds)}
        write(sinks.svg_chart(series, f"{split}, {category}: precision over recall", "recall", "precision"), f"charts/precision_recall_{split}_{category}.svg")
        series = {f"{m} {f}": line(m, "threshold", f) for m in sorted(c.thresholds) for f in ("f1", "f2")}
        write(sinks.svg_chart(series, f"{split}, {category}: F scores by confidence", "confidence", "score"), f"charts/f_scores_{split}_{category}.svg")
    pages = review.priorities_by_image(c.errors).orderBy("split", "file_name")
    cells = pages.select(
        "split", "file_name", F.array_join("review_priorities", ", ").alias("priorities"), F.array_join("error_types", " | ").alias("errors"),
        F.concat(F.lit(f"{images_at}/"), "file_name").alias("image"),
    )
    page: list[dict] = []
    count: dict[str, int] = {}

    def flush() -> None:
        if page:
            split = page[0]["split"]
            count[split] = count.get(split, 0) + 1
            write(sinks.html_page(f"{split}: images with errors", page, ["file_name", "priorities", "errors"], "image"), f"review/{split}_{count[split]:04d}.html")
            page.clear()

    for r in cells.toLocalIterator():
        if page and (r["split"] != page[0]["split"] or len(page) == MOST_ON_PAGE):
            flush()
        page.append(r.asDict())
    flush()
