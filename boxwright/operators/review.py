"""Review tables of a model's matches: images, boxes, errors and their priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.functions.geometry import fields, iou
from boxwright.functions.names import recording_id, timestamp_seconds
from boxwright.functions.rounding import exact_round
from boxwright.operators.matching import CONFUSION, FALSE_NEGATIVE, FALSE_POSITIVE, TRUE_POSITIVE

#: From the least to the most urgent.
PRIORITIES = ("model_error", "shared_missed_gt", "shared_high_confidence_fp", "model_only_error", "left_right_disagreement")


def provenance() -> list[Column]:
    name = F.col("file_name")
    return [recording_id(name).alias("source_recording"), timestamp_seconds(name).alias("timestamp_seconds")]


def box_json(box: Column) -> Column:
    """A box as JSON text to four places; null for no box."""
    values = F.array(*[exact_round(c, 4, plain=True) for c in fields(box)])
    return F.when(box.isNotNull(), F.replace(F.to_json(values), F.lit(","), F.lit(", ")))


def image_manifest(images: DataFrame, matches: DataFrame, models: tuple[str, ...], key: str = "image_id") -> DataFrame:
    """A row for each image and model: counts of each kind, overlaps of true positives, surest false positive."""
    kind = F.col("match_type")
    of = lambda k: F.count_if(kind == k)
    counts = matches.groupBy(key, "model_name").agg(
        of(TRUE_POSITIVE).alias("true_positive_count"), of(FALSE_POSITIVE).alias("false_positive_count"),
        of(FALSE_NEGATIVE).alias("false_negative_count"), of(CONFUSION).alias("class_confusion_count"),
        exact_round(F.min(F.when(kind == TRUE_POSITIVE, F.col("iou"))), 6).alias("minimum_true_positive_iou"),
        exact_round(F.avg(F.when(kind == TRUE_POSITIVE, F.col("iou"))), 6).alias("mean_true_positive_iou"),
        exact_round(F.max(F.when(kind == FALSE_POSITIVE, F.col("confidence"))), 6).alias("maximum_false_positive_confidence"),
    )
    every = images.withColumn("model_name", F.explode(F.array(*map(F.lit, models))))
    names = [c for c in counts.columns if c.endswith("_count")]
    out = every.join(counts, [key, "model_name"], "left").fillna(0, names)
    return out.select("split", "file_name", *provenance(), *counts.columns[1:])


def false_positive_page(manifest: DataFrame) -> DataFrame:
    return manifest.where("false_positive_count > 0").orderBy(
        F.desc("false_positive_count"), F.desc(F.coalesce("maximum_false_positive_confidence", F.lit(0.0))), "file_name"
    )


def false_negative_page(manifest: DataFrame) -> DataFrame:
    return manifest.where("false_negative_count > 0").orderBy(F.desc("false_negative_count"), "file_name")


def lowest_iou_page(manifest: DataFrame) -> DataFrame:
    return manifest.where("minimum_true_positive_iou is not null").orderBy("minimum_true_positive_iou", "file_name")


def confusion_page(manifest: DataFrame) -> DataFrame:
    return manifest.where("class_confusion_count > 0").orderBy(F.desc("class_confusion_count"), "file_name")


def all_images_page(manifest: DataFrame) -> DataFrame:
    return manifest.orderBy("file_name")


def box_manifest(images: DataFrame, matches: DataFrame, key: str = "image_id") -> DataFrame:
    """A row for each box of the complete review."""
    rows = matches.join(images.select(key, "split", "file_name"), key)
    return rows.select(
        "split", "file_name", *provenance(), "model_name", "match_type", "category",
        F.coalesce("predicted_category", "category").alias("predicted_category"),
        exact_round(F.col("confidence"), 6, plain=True).alias("confidence"), exact_round(F.col("iou"), 6, plain=True).alias("iou"),
        box_json(F.col("p")).alias("prediction_bbox_xyxy"), box_json(F.col("g")).alias("ground_truth_bbox_xyxy"),
    )


def shared_false_negatives(matches: DataFrame, first: str, second: str) -> DataFrame:
    """Ids of annotations that both models miss."""
    missed = lambda m: matches.where((F.col("match_type") == FALSE_NEGATIVE) & (F.col("model_name") == m)).select("annotation_id")
    return missed(first).join(missed(second), "annotation_id", "left_semi")


def shared_false_positives(matches: DataFrame, first: str, second: str, least: float = 0.5, key: str = "image_id") -> DataFrame:
    """Pairs of both models' false positives of one image and class that overlap."""
    alone = lambda m, n: matches.where((F.col("match_type") == FALSE_POSITIVE) & (F.col("model_name") == m)).select(
        key, "category", F.col("det_pos").alias(f"{n}_det_pos"), F.col("p").alias(f"{n}_p")
    )
    both = alone(first, "first").join(alone(second, "second"), [key, "category"])
    overlap = iou(fields(F.col("first_p")), fields(F.col("second_p")))
    return both.where(overlap >= least).select(key, "category", "first_det_pos", "second_det_pos", overlap.alias("iou"))


def error_images(matches: DataFrame, key: str = "image_id") -> DataFrame:
    return matches.where(F.col("match_type") != TRUE_POSITIVE).select(key, "model_name").distinct()


def judged_errors(matches: DataFrame, first: str, second: str, key: str = "image_id") -> DataFrame:
    """A row for each image with an error: `errors`, its matches that are no true positives, and `priorities`, by model.

    All errors of an image meet in its row, so the models are compared inside it, without joining matches to themselves.
    """
    columns = ("model_name", "match_type", "category", "predicted_category", "confidence", "iou", "annotation_id", "p", "g")
    wrong = matches.where(F.col("match_type") != TRUE_POSITIVE)
    rows = wrong.groupBy(key).agg(F.collect_list(F.struct(*columns)).alias("errors"))
    of = lambda m, kind: F.filter("errors", lambda e: (e["model_name"] == m) & (e["match_type"] == kind))
    ids = lambda m: F.transform(of(m, FALSE_NEGATIVE), lambda e: e["annotation_id"])
    both_miss = F.arrays_overlap(ids(first), ids(second))
    both_find = F.exists(
        of(first, FALSE_POSITIVE),
        lambda a: F.exists(
            of(second, FALSE_POSITIVE),
            lambda b: (a["category"] == b["category"]) & (iou(fields(a["p"]), fields(b["p"])) >= 0.5),
        ),
    )
    has = lambda m: F.exists("errors", lambda e: e["model_name"] == m)

    def priority(model: str, other: str) -> Column:
        confused = F.exists("errors", lambda e: (e["model_name"] == model) & (e["match_type"] == CONFUSION))
        return (
            F.when(~has(model), F.lit(None).cast("string"))
            .when(confused, PRIORITIES[4])
            .when(~has(other), PRIORITIES[3])
            .when(both_find, PRIORITIES[2])
            .when(F.coalesce(both_miss, F.lit(False)), PRIORITIES[1])
            .otherwise(PRIORITIES[0])
        )

    return rows.withColumn(
        "priorities", F.create_map(F.lit(first), priority(first, second), F.lit(second), priority(second, first))
    )


def review_priority(matches: DataFrame, first: str, second: str, key: str = "image_id") -> DataFrame:
    """The most urgent reason to look at an image for a model; a row for each image and model with an error."""
    rows = judged_errors(matches, first, second, key)
    return rows.select(key, F.explode("priorities").alias("model_name", "review_priority")).where("review_priority is not null")


def error_manifest(images: DataFrame, matches: DataFrame, first: str, second: str, key: str = "image_id") -> DataFrame:
    """A row for each error box, with its image's priority for the model."""
    rows = judged_errors(matches, first, second, key).select(key, "priorities", F.explode("errors").alias("e"))
    rows = rows.join(images.select(key, "split", "file_name"), key).select("split", "file_name", "priorities", "e.*")
    return rows.select(
        "split", "model_name", "file_name", *provenance(), F.col("match_type").alias("error_type"), "category",
        "predicted_category", "confidence",
        F.coalesce(box_json(F.col("p")), box_json(F.col("g"))).alias("bbox_xyxy"), exact_round(F.col("iou"), 6, plain=True).alias("iou"),
        F.coalesce(F.try_element_at("priorities", F.col("model_name")), F.lit(PRIORITIES[0])).alias("review_priority"),
    )


def priorities_by_image(manifest: DataFrame) -> DataFrame:
    """For each image the sorted priorities and error types that the error manifest has for it."""
    return manifest.groupBy("split", "file_name").agg(
        F.array_sort(F.collect_set("review_priority")).alias("review_priorities"),
        F.array_sort(F.collect_set("error_type")).alias("error_types"),
    )
