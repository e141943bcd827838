"""Average precision as COCO defines it: ten overlap thresholds, 101 recall points, best 100 detections a class and image.

For each image, class and threshold the detections, most confident first, take the free box with the largest overlap
(the last one of ties). A crowd box may be taken any number of times, by detections that find no other: their overlap with it is
the share of the detection's own area, and they count neither as right nor as wrong. Over a class of a split, precision along the
detections is made monotone from the right and read at each recall point. Ties of confidence between images are in the order of
image ids.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxwright.functions.geometry import area, fields
from boxwright.operators.evaluation import MICRO
from boxwright.operators.matching import edges, image_rows
from boxwright.sources.scratch import drop_stored, stored

THRESHOLDS = tuple(round(0.5 + 0.05 * k, 2) for k in range(10))
MOST_DETECTIONS = 100
_K = range(len(THRESHOLDS))


def _reached(overlap: Column) -> Column:
    """The thresholds that an overlap reaches, a bit for each."""
    return reduce(Column.bitwiseOR, [F.when(overlap >= min(t, 1 - 1e-10), 1 << k).otherwise(0) for k, t in enumerate(THRESHOLDS)])


def _cover(p: Column, g: Column) -> Column:
    """The share of a detection's area that lies in a crowd box."""
    a, b = fields(p), fields(g)
    zero = F.lit(0.0)
    inner = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return F.when(area(a) > 0, inner / area(a)).otherwise(zero)


def _flags(rows: DataFrame, key: str) -> DataFrame:
    """A row for each detection: confidence, place, and as bits by threshold `hits` (it takes a box) and `out` (only a crowd). Each class of an image on its own."""
    rows = rows.withColumn("category", F.explode(F.array_distinct(F.transform("p", lambda p: p["category"]))))
    mine = lambda c: F.filter(c, lambda x: x["category"] == F.col("category"))
    rows = rows.withColumn("p", F.slice(mine("p"), 1, MOST_DETECTIONS)).withColumn("g", mine("g"))
    crowd = lambda yes: F.filter("g", lambda g: (F.coalesce(g["iscrowd"], F.lit(0)) != 0) == F.lit(yes))
    # places among the class's own boxes, the last one first as it wins ties
    box = ("x1", "y1", "x2", "y2", "area")
    rows = rows.withColumn("crowd", crowd(True)).withColumn("g", crowd(False))
    rows = rows.withColumn("p", F.transform("p", lambda p, i: F.struct(i.cast("int").alias("i"), p["confidence"].alias("confidence"), *[p[c].alias(c) for c in box])))
    rows = rows.withColumn("g", F.transform("g", lambda g, i: F.struct((-i).cast("int").alias("i"), *[g[c].alias(c) for c in box])))
    rows = rows.withColumn("edges", edges("p", "g", THRESHOLDS[0], lambda p, g, overlap: F.array(F.lit(1))))
    bits = lambda taken: F.aggregate(taken, F.lit(0), lambda b, t: b.bitwiseOR(t["bits"]))

    def step(taken: Column, e: Column) -> Column:
        """One walk over the edges for all thresholds: an edge is taken at those that it reaches and at which both ends are free."""
        used = bits(F.filter(taken, lambda t: (t["i"] == e["i"]) | (t["j"] == e["j"])))
        free = _reached(-e["back"]).bitwiseAND(F.bitwise_not(used))
        return F.when(free == 0, taken).otherwise(F.array_append(taken, F.struct(e["i"].alias("i"), e["j"].alias("j"), free.alias("bits"))))

    none = F.expr("cast(array() as array<struct<i:int,j:int,bits:int>>)")
    rows = rows.withColumn("taken", F.aggregate("edges", none, step))

    def judged(p: Column) -> Column:
        hits = bits(F.filter("taken", lambda t: t["i"] == p["i"]))
        over = F.aggregate("crowd", F.lit(0), lambda b, g: b.bitwiseOR(_reached(_cover(p, g))))
        return F.struct(p["confidence"].alias("confidence"), p["i"].alias("place"), hits.alias("hits"), over.bitwiseAND(F.bitwise_not(hits)).alias("out"))

    found = F.transform("p", judged)
    return rows.select(key, "model_name", "category", F.explode(found).alias("d")).select(key, "model_name", "category", "d.*")


def average_precision(
    images: DataFrame, ground_truth: DataFrame, predictions: DataFrame, models: Sequence[str], key: str = "image_id"
) -> DataFrame:
    """ap50, ap75 and map_50_95 for each split, model and category, and overall as the mean of categories with boxes.

    Not rounded. Categories without ground truth, crowds aside, have no row; without predictions all is 0. ground_truth may have a
    column iscrowd. The ranked detections are kept in the checkpoint folder, so this runs a job.

    Detections are ranked in two steps: inside the ranges of a global order of split, model, category, confidence and image, and over
    the ranges' sums. Ranges come from a sample of what is there, so that they hold about as many detections each, whatever their
    confidences, and equal confidences part by image. The largest precision from a place on is found alike.
    """
    split = images.select(key, "split")
    by = ["split", "model_name", "category"]
    crowds = "iscrowd" in ground_truth.columns
    truth = ground_truth if crowds else ground_truth.withColumn("iscrowd", F.lit(0))
    n_gt = truth.where(F.coalesce("iscrowd", F.lit(0)) == 0).select(key, "category").join(split, key)
    n_gt = n_gt.groupBy("split", "category").agg(F.count(F.lit(1)).alias("n_gt"))
    order = [F.desc("confidence"), F.asc(key), F.asc("place")]
    flags = _flags(image_rows(truth, predictions, models, key, ["iscrowd"]), key).join(split, key)
    # kept before they are dealt out too, as the ranges' sample is a pass of its own
    found = stored(flags)
    flags = stored(found.repartitionByRange(*by, *order).withColumn("range", F.spark_partition_id()))
    drop_stored(found)
    bit = lambda column, k: F.shiftright(column, k).bitwiseAND(F.lit(1))
    # counts of detections that are right, and of those that count, by threshold; without crowds the latter are the same for all
    ranks = {k: f"n{k if crowds else 0}" for k in _K}
    counts = {f"tp{k}": bit("hits", k) for k in _K} | {ranks[k]: 1 - bit("out", k) if crowds else F.lit(1) for k in _K}
    before = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range, split, model and category from here on in `sums`
    sums = flags.groupBy(*by, "range").agg(*[F.sum(v).alias(c) for c, v in counts.items()])
    sums = sums.select(*by, "range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in counts])
    inside = Window.partitionBy(*by, "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    hits = flags.withColumns({c: F.sum(v).over(inside) for c, v in counts.items()}).where("hits <> 0")
    # precision only matters where a box is taken: elsewhere recall stays and precision falls
    hits = hits.join(sums, [*by, "range"]).withColumns({c: F.col(c) + F.col(f"before_{c}") for c in counts})
    # what is right and what counts, from which the precision follows
    hits = stored(hits.select(*by, "range", "confidence", key, "place", "hits", *counts))
    drop_stored(flags)
    hits = hits.withColumns({f"p{k}": F.when(bit("hits", k) == 1, F.col(f"tp{k}") / F.col(ranks[k])) for k in _K})
    after = Window.partitionBy(*by).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    best = hits.groupBy(*by, "range").agg(*[F.max(f"p{k}").alias(f"m{k}") for k in _K])
    best = best.select(*by, "range", *[F.max(f"m{k}").over(after).alias(f"after{k}") for k in _K])
    right = Window.partitionBy(*by, "range").orderBy(F.asc("confidence"), F.desc(key), F.desc("place"))
    right = right.rowsBetween(Window.unboundedPreceding, 0)
    rows = hits.withColumns({f"best{k}": F.max(f"p{k}").over(right) for k in _K}).join(best, [*by, "range"])
    rows = rows.join(F.broadcast(n_gt), ["split", "category"])  # a row for each split and category

    def below(tp: Column) -> Column:
        """Recall points k * 0.01 at or below tp / n_gt."""
        recall = tp / F.col("n_gt")
        k = F.floor(recall * 100)
        return F.when((k + 1) * 0.01 <= recall, k + 2).when(k * 0.01 > recall, k).otherwise(k + 1)

    points = lambda tp: below(tp) - F.when(tp == 1, 0).otherwise(below(tp - 1))
    each = rows.groupBy(*by).agg(
        *[F.sum(F.when(bit("hits", k) == 1, F.greatest(f"best{k}", f"after{k}") * points(F.col(f"tp{k}")))).alias(f"ap{k}") for k in _K]
    )
    keys = n_gt.select("split", F.explode(F.array(*map(F.lit, models))).alias("model_name"), "category")
    each = keys.join(each, by, "left").fillna(0.0, [f"ap{k}" for k in _K])
    each = each.select(
        *by, (F.col("ap0") / 101).alias("ap50"), (F.col("ap5") / 101).alias("ap75"),
        (reduce(Column.__add__, [F.col(f"ap{k}") for k in _K]) / (101 * len(THRESHOLDS))).alias("map_50_95"),
    )
    overall = each.groupBy("split", "model_name").agg(
        F.lit(MICRO).alias("category"), *[F.avg(c).alias(c) for c in ("ap50", "ap75", "map_50_95")]
    )
    return each.unionByName(overall)
