"""What has changed between two revisions of a dataset: images by their stable key, boxes by overlap.

Old boxes, in their order, first take the free new box of their class with the largest overlap, if that is at least
`unchanged`; those pairs are no change. Old boxes left over then take the free new box of any class with the largest
overlap, if that is at least `related`: moved, or relabelled. The rest are removed or added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.functions.names import stable_image_key
from boxwright.functions.rounding import exact_round
from boxwright.operators.matching import edges, greedy, numbered

_NAMES = ("category", "x1", "y1", "x2", "y2")


def revision_images(images: DataFrame, boxes: DataFrame, key: str = "image_id") -> DataFrame:
    """image_key, split, file_name and boxes (an array in their order) for each image."""
    arrays = boxes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ann_ord", *_NAMES))).alias("boxes"))
    rows = images.join(arrays, key, "left").select(
        stable_image_key(F.col("file_name")).alias("image_key"), "split", "file_name", numbered("boxes", _NAMES).alias("boxes")
    )
    return rows.withColumn("boxes", F.coalesce("boxes", F.array().cast(dict(rows.dtypes)["boxes"])))


def changes(old: DataFrame, new: DataFrame, unchanged: float = 0.95, related: float = 0.5) -> DataFrame:
    """A row for each change. old, new: revision_images()."""
    if not 0 <= related <= unchanged <= 1:
        raise ValueError("0 <= related <= unchanged <= 1 is needed")
    side = lambda df, n: df.select("image_key", *[F.col(c).alias(f"{n}_{c}") for c in ("split", "file_name", "boxes")])
    both = side(old, "old").join(side(new, "new"), "image_key", "full")
    kind = dict(both.dtypes)["old_boxes"]
    both = both.withColumns({f"{n}_array": F.coalesce(f"{n}_boxes", F.array().cast(kind)) for n in ("old", "new")})
    # an edge can be taken as unchanged, and if it isn't, as related
    phase = lambda o, n, overlap: F.filter(
        F.array(
            F.when((overlap >= unchanged) & (o["category"] == n["category"]), 1), F.when(overlap >= related, 2)
        ),
        lambda x: x.isNotNull(),
    )
    both = both.withColumn("edges", edges("old_array", "new_array", related, phase)).withColumn("taken", greedy("edges"))
    no_box = F.lit(None).cast(kind.removeprefix("array<")[:-1])

    def row(change: Column, a: Column, b: Column, overlap: Column) -> Column:
        return F.struct(change.alias("change_type"), a.alias("old"), b.alias("new"), overlap.alias("iou"))

    no_iou = F.lit(None).cast("double")
    old_at = lambda i: F.get("old_array", i)
    new_at = lambda i: F.get("new_array", i)
    moved = F.transform(
        F.filter("taken", lambda t: t["phase"] == 2),
        lambda t: row(
            F.when(old_at(t["i"])["category"] == new_at(t["j"])["category"], "bbox_adjusted").otherwise("relabeled"),
            old_at(t["i"]), new_at(t["j"]), -t["back"],
        ),
    )
    removed = F.transform(
        F.filter("old_array", lambda x: ~F.exists("taken", lambda t: t["i"] == x["i"])),
        lambda x: row(F.lit("annotation_removed"), x, no_box, no_iou),
    )
    added = F.transform(
        F.filter("new_array", lambda x: ~F.exists("taken", lambda t: t["j"] == x["i"])),
        lambda x: row(F.lit("annotation_added"), no_box, x, no_iou),
    )
    moved_split = F.when(
        F.col("old_split") != F.col("new_split"), F.array(row(F.lit("split_moved"), no_box, no_box, no_iou))
    ).otherwise(F.filter(removed, lambda _: F.lit(False)))

    def whole(column: str, change: str, old_side: bool) -> Column:
        one = lambda x: row(F.lit(change), x if old_side else no_box, no_box if old_side else x, no_iou)
        return F.when(F.size(column) > 0, F.transform(column, one)).otherwise(F.array(one(no_box)))

    found = (
        F.when(F.col("old_boxes").isNull(), whole("new_array", "image_added", False))
        .when(F.col("new_boxes").isNull(), whole("old_array", "image_removed", True))
        .otherwise(F.concat(moved_split, moved, removed, added))
    )
    box = lambda s: F.when(s.isNotNull(), F.array(*[s[c] for c in _NAMES[1:]]))
    out = both.select("image_key", "old_file_name", "new_file_name", "old_split", "new_split", F.explode(found).alias("c"))
    return out.select(
        F.col("image_key").alias("stable_image_key"), "old_file_name", "new_file_name", "old_split", "new_split",
        F.col("c.change_type").alias("change_type"), F.col("c.old.category").alias("old_category"),
        F.col("c.new.category").alias("new_category"), box(F.col("c.old")).alias("old_bbox_xyxy"),
        box(F.col("c.new")).alias("new_bbox_xyxy"), exact_round(F.col("c.iou"), 6, plain=True).alias("iou"),
    )


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))
