"""One-to-one matching of predictions and ground truth in each image.

Predictions, most confident first, take the best free box of their class with enough overlap; then those left, in the
same order, take the best free box of another class (a class confusion). What is left over is a false positive or a
false negative. Ties go to the earlier prediction and to the earlier ground-truth box.

An image is one row with its boxes as arrays, so all boxes of an image meet through one exchange on its key for both
sides. Overlaps are computed once, as an array of the edges that are large enough; in the order of phase, prediction, overlap and
ground-truth box, an edge is taken if both of its ends are still free. That walk is a fold over the few edges left. Images with
too many boxes for one row are matched by crowds.py, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.functions.geometry import area, fields, iou

TRUE_POSITIVE, CONFUSION, FALSE_POSITIVE, FALSE_NEGATIVE = (
    "true_positive",
    "class_confusion",
    "false_positive",
    "false_negative",
)


def confident(predictions: DataFrame, threshold: float) -> DataFrame:
    """Predictions of at least this confidence."""
    return predictions.where(F.col("confidence") >= threshold)


def iou_pairs(ground_truth: DataFrame, predictions: DataFrame, least: float = 0.5, key: str = "image_id") -> DataFrame:
    """Pairs of a prediction and a ground-truth box of one image whose overlap is at least `least` and not 0."""
    a, b = predictions.alias("p"), ground_truth.alias("g")
    overlap = iou(tuple(F.col(f"p.{c}") for c in ("x1", "y1", "x2", "y2")), tuple(F.col(f"g.{c}") for c in ("x1", "y1", "x2", "y2")))
    return (
        a.join(b, key)
        .select(
            "p.model_name", key, "p.det_pos", "g.ann_ord", (F.col("p.category") == F.col("g.category")).alias("same"),
            overlap.alias("iou"),
        )
        .where((F.col("iou") >= least) & (F.col("iou") > 0))
    )


def edges(left: str, right: str, least: float, phase: Callable[[Column, Column, Column], Column]) -> Column:
    """Sorted edges between the elements of two arrays of numbered(): phase, i, back (minus the overlap), j, the places i and j in the arrays.

    phase(one, other, overlap): the walks in which an edge can be taken, an array of numbers. Overlaps below `least` make no edge.
    """

    def overlap(x: Column, y: Column) -> tuple[Column, Column, Column]:
        """Width and height of what two boxes share, and their overlap where both are above 0, as geometry.iou() has it."""
        width = F.least(x["x2"], y["x2"]) - F.greatest(x["x1"], y["x1"])
        height = F.least(x["y2"], y["y2"]) - F.greatest(x["y1"], y["y1"])
        return width, height, width * height / (x["area"] + y["area"] - width * height)

    def near(x: Column, y: Column) -> Column:
        width, height, share = overlap(x, y)
        return (width > 0) & (height > 0) & (share >= least)

    def rated(x: Column) -> Column:
        # few pairs are near, so overlaps are computed anew for these rather than carried along for all
        made = F.transform(
            F.filter(right, lambda y: near(x, y)),
            lambda y: F.transform(
                phase(x, y, overlap(x, y)[2]),
                lambda n: F.struct(n.alias("phase"), x["i"].alias("i"), (-overlap(x, y)[2]).alias("back"), y["i"].alias("j")),
            ),
        )
        return F.flatten(made)

    return F.sort_array(F.flatten(F.transform(left, rated)))


def greedy(sorted_edges: str) -> Column:
    """The edges that are taken: in order, each of which both ends are free."""
    none = F.expr("cast(array() as array<struct<phase:int,i:int,back:double,j:int>>)")
    return F.aggregate(
        sorted_edges,
        none,
        lambda taken, e: F.when(
            F.exists(taken, lambda t: (t["i"] == e["i"]) | (t["j"] == e["j"])), taken
        ).otherwise(F.array_append(taken, e)),
    )


def numbered(column: str, names: Sequence[str]) -> Column:
    """A sorted array of structs of boxes with `i`, each one's place, and its area."""
    return F.transform(
        column, lambda x, i: F.struct(i.cast("int").alias("i"), *[x[n].alias(n) for n in names], area(fields(x)).alias("area"))
    )


_BOX = ("x1", "y1", "x2", "y2")
_P = ("det_pos", "confidence", "category", *_BOX)
_G = ("ann_ord", "annotation_id", "category", *_BOX)


def image_rows(
    ground_truth: DataFrame, predictions: DataFrame, models: Sequence[str], key: str = "image_id", more: Sequence[str] = (),
    more_p: Sequence[str] = (),
) -> DataFrame:
    """A row for each model and image with a box: its predictions p, with columns `more_p`, and ground-truth boxes g, with columns `more`, as arrays."""
    # all models' predictions of an image travel together, so that each side is dealt out by image once
    p = predictions.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("_order"), *_P, "model_name", *more_p))).alias("all")
    )
    g = ground_truth.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*_G, *more))).alias("g"))
    both = p.join(g, key, "full").withColumn("model_name", F.explode(F.array(*map(F.lit, models))))
    both = both.withColumn("p", F.filter("all", lambda x: x["model_name"] == F.col("model_name"))).drop("all")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    both = both.withColumn("p", numbered("p", (*_P, *more_p))).withColumn("g", numbered("g", (*_G, *more)))
    kinds = dict(both.dtypes)
    return both.withColumn("p", none(F.col("p"), kinds["p"])).withColumn("g", none(F.col("g"), kinds["g"]))


def match(
    ground_truth: DataFrame,
    predictions: DataFrame,
    models: Sequence[str],
    threshold: float = 0.0,
    least: float = 0.5,
    key: str = "image_id",
    confusions: bool = True,
) -> DataFrame:
    """A row for each match, false positive and false negative.

    key, model_name, match_type, category (of the ground truth, or of a false positive's prediction),
    predicted_category, confidence, iou, det_pos, annotation_id, p (the prediction) and g (the ground-truth box).
    """
    rows = image_rows(ground_truth, confident(predictions, threshold), models, key)
    phase = lambda p, g, overlap: F.when(
        F.lit(confusions) | (p["category"] == g["category"]), F.array(F.when(p["category"] == g["category"], 1).otherwise(2))
    ).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("edges", edges("p", "g", least, phase)).withColumn("taken", greedy("edges"))
    kinds = dict(rows.dtypes)
    p_kind, g_kind = (kinds[c].removeprefix("array<")[:-1] for c in ("p", "g"))

    def out(kind: Column, p: Column, g: Column, overlap: Column) -> Column:
        return F.struct(kind.alias("match_type"), p.alias("p"), g.alias("g"), overlap.alias("iou"))

    no_p, no_g, no_iou = F.lit(None).cast(p_kind), F.lit(None).cast(g_kind), F.lit(None).cast("double")
    pairs = F.transform(
        "taken",
        lambda t: out(
            F.when(t["phase"] == 1, TRUE_POSITIVE).otherwise(CONFUSION), F.get("p", t["i"]), F.get("g", t["j"]), -t["back"]
        ),
    )
    alone = F.transform(
        F.filter("p", lambda x: ~F.exists("taken", lambda t: t["i"] == x["i"])),
        lambda x: out(F.lit(FALSE_POSITIVE), x, no_g, no_iou),
    )
    missed = F.transform(
        F.filter("g", lambda x: ~F.exists("taken", lambda t: t["j"] == x["i"])),
        lambda x: out(F.lit(FALSE_NEGATIVE), no_p, x, no_iou),
    )
    found = rows.select(key, "model_name", F.explode(F.concat(pairs, alone, missed)).alias("m"))
    return found.select(
        key, "model_name", F.col("m.match_type").alias("match_type"),
        F.coalesce("m.g.category", "m.p.category").alias("category"),
        F.col("m.p.category").alias("predicted_category"), F.col("m.p.confidence").alias("confidence"),
        F.col("m.iou").alias("iou"), F.col("m.p.det_pos").alias("det_pos"),
        F.col("m.g.annotation_id").alias("annotation_id"), F.col("m.p").alias("p"), F.col("m.g").alias("g"),
    )
