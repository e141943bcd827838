"""Counts, threshold sweeps, operating points, metric rows and their comparison.

One greedy walk over all predictions serves every threshold: first-phase matches are taken in order of confidence, so
a threshold only cuts the walk short, and false positives and negatives follow from totals. The sweep is therefore one
aggregation by confidence and a running sum.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxwright.functions.names import CATEGORIES
from boxwright.functions.rounding import exact_round
from boxwright.functions.scores import fbeta, precision, recall
from boxwright.operators.matching import CONFUSION, FALSE_NEGATIVE, FALSE_POSITIVE, TRUE_POSITIVE, match

MICRO, MACRO = "overall_micro", "macro_classes"
METRICS = ("precision", "recall", "f1", "f2", "ap50", "ap75", "map_50_95")


def with_micro(df: DataFrame) -> DataFrame:
    """Each row once for its category and once for all of them together."""
    return df.withColumn("category", F.explode(F.array("category", F.lit(MICRO))))


def match_counts(matches: DataFrame, by: Sequence[str] = ("model_name",)) -> DataFrame:
    """tp, fp, fn and confusions for each category and overall; a confusion is one FP and one FN, of its two classes.

    confusions of a category: those with it on either side.
    """
    kind = F.col("match_type")
    one = lambda ok: ok.cast("long")
    sides = F.when(
        kind == CONFUSION,
        F.array(
            F.struct(F.col("predicted_category").alias("category"), F.lit(1).alias("fp"), F.lit(0).alias("fn")),
            F.struct(F.col("category").alias("category"), F.lit(0).alias("fp"), F.lit(1).alias("fn")),
        ),
    ).otherwise(
        F.array(
            F.struct(
                F.col("category").alias("category"),
                (kind == FALSE_POSITIVE).cast("int").alias("fp"),
                (kind == FALSE_NEGATIVE).cast("int").alias("fn"),
            )
        )
    )
    rows = matches.select(*by, kind, F.explode(sides).alias("s"))
    rows = rows.select(
        *by, F.col("s.category").alias("category"), one(kind == TRUE_POSITIVE).alias("tp"),
        F.col("s.fp").cast("long").alias("fp"), F.col("s.fn").cast("long").alias("fn"),
        one(kind == CONFUSION).alias("sides"),
    )
    sums = with_micro(rows).groupBy(*by, "category").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "sides")])
    # overall, each confusion has been counted from both of its sides
    confusions = F.when(F.col("category") == MICRO, F.col("sides") / 2).otherwise(F.col("sides")).cast("long")
    return sums.withColumn("confusions", confusions).drop("sides")


def scored(df: DataFrame) -> DataFrame:
    """Add precision, recall, f1 and f2 of tp, fp and fn, to six places."""
    p, r = precision(F.col("tp"), F.col("fp")), recall(F.col("tp"), F.col("fn"))
    return df.withColumns(
        {
            "precision": exact_round(p, 6), "recall": exact_round(r, 6),
            "f1": exact_round(fbeta(p, r, 1.0), 6), "f2": exact_round(fbeta(p, r, 2.0), 6),
        }
    )


def metric_keys(splits: DataFrame, models: Sequence[str]) -> DataFrame:
    """splits (a row for each, with its image_count) times models times the categories and all of them together."""
    every = lambda names: F.explode(F.array(*map(F.lit, names)))
    return splits.withColumn("model_name", every(models)).withColumn("category", every((MICRO, *CATEGORIES)))


def threshold_sweep(
    images: DataFrame,
    ground_truth: DataFrame,
    predictions: DataFrame,
    models: Sequence[str],
    least: float = 0.5,
    key: str = "image_id",
    matcher: Callable[..., DataFrame] = match,
) -> DataFrame:
    """tp, fp and fn at every confidence that occurs, and at 0 and 1, for each split, model and category, with boxes or without.

    Overall, boxes of one category only ever match that category, so its walk is the two categories' walks together.
    """
    split = images.select(key, "split")
    found = matcher(ground_truth, predictions, models, 0.0, least, key, confusions=False).where("p is not null")
    found = found.join(split, key).select(
        "split", "model_name", F.col("predicted_category").alias("category"), "confidence",
        (F.col("match_type") == TRUE_POSITIVE).cast("long").alias("tp"),
    )
    by = ["split", "model_name", "category"]
    steps = with_micro(found).groupBy(*by, "confidence").agg(F.sum("tp").alias("tp"), F.count(F.lit(1)).alias("n"))
    totals = with_micro(ground_truth.select(key, "category").join(split, key).select("split", "category")).groupBy("split", "category").agg(
        F.count(F.lit(1)).alias("gt")
    )
    keys = metric_keys(images.groupBy("split").agg(F.count(F.lit(1)).alias("image_count")), models)
    ends = keys.select(
        *by, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("confidence"), F.lit(0).cast("long").alias("tp"),
        F.lit(0).cast("long").alias("n"),
    )
    steps = steps.unionByName(ends).groupBy(*by, "confidence").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"))
    so_far = Window.partitionBy(*by).orderBy(F.desc("confidence")).rowsBetween(Window.unboundedPreceding, 0)
    # the number of different confidences bounds a partition, not the number of boxes
    return (
        steps.withColumns({"tp": F.sum("tp").over(so_far), "n": F.sum("n").over(so_far)})
        .join(F.broadcast(totals), ["split", "category"], "left")  # a few rows for each split
        .select(
            *by, F.col("confidence").alias("threshold"), "tp", (F.col("n") - F.col("tp")).alias("fp"),
            (F.coalesce("gt", F.lit(0)) - F.col("tp")).alias("fn"),
        )
    )


def select_thresholds(sweep: DataFrame) -> DataFrame:
    """For each split, model and category the thresholds with the best rounded F1 and F2, the larger one of ties."""
    rows = scored(sweep).withColumn("threshold", exact_round(F.col("threshold"), 6, plain=True))
    best = lambda f: F.max(F.struct(f, "threshold"))["threshold"].alias(f"{f}_threshold")
    top = lambda f: F.max(f).alias(f"best_{f}")
    return rows.groupBy("split", "model_name", "category").agg(best("f1"), top("f1"), best("f2"), top("f2"))


def evaluation_rows(
    images: DataFrame,
    ground_truth: DataFrame,
    predictions: DataFrame,
    models: Sequence[str],
    threshold: float,
    least: float = 0.5,
    average_precision: DataFrame | None = None,
    key: str = "image_id",
    matches: DataFrame | None = None,
) -> DataFrame:
    """A metric row for each split, model and category, overall and in the classes' mean.

    matches: those of match() for the same models, threshold and overlap, if they are there already.

    average_precision: split, model_name, category, ap50, ap75 and map_50_95, rounded here; zeros without it.
    """
    found = match(ground_truth, predictions, models, threshold, least, key) if matches is None else matches
    found = found.join(images.select(key, "split"), key)
    by = ["split", "model_name"]
    keys = metric_keys(images.groupBy("split").agg(F.count(F.lit(1)).alias("image_count")), models)
    # every prediction is a true or a false positive, every box a true positive or a false negative
    rows = keys.join(match_counts(found, by), [*by, "category"], "left").withColumns(
        {"prediction_count": F.col("tp") + F.col("fp"), "ground_truth_count": F.col("tp") + F.col("fn")}
    )
    if average_precision is not None:
        ap = average_precision.withColumns({c: exact_round(F.col(c), 6) for c in METRICS[4:]})
        rows = rows.join(ap, [*by, "category"], "left")
    else:
        rows = rows.withColumns({c: F.lit(0.0) for c in METRICS[4:]})
    whole = ("tp", "fp", "fn", "confusions", "ground_truth_count", "prediction_count")
    rows = rows.fillna(0, list(whole)).fillna(0.0, list(METRICS[4:]))
    rows = scored(rows).select(
        "split", "model_name", "category", F.lit(round(threshold, 6)).alias("confidence_threshold"),
        F.lit(least).alias("iou_threshold"), "image_count", *whole, *METRICS,
    )
    return rows.unionByName(macro_rows(rows))


def macro_rows(rows: DataFrame) -> DataFrame:
    """The classes' row for each split and model: means of the rounded values, sums of counts, most confusions."""
    classes = rows.where(F.col("category").isin(*CATEGORIES))
    sums = ("tp", "fp", "fn", "ground_truth_count", "prediction_count")
    return classes.groupBy("split", "model_name", "confidence_threshold", "iou_threshold").agg(
        F.lit(MACRO).alias("category"), F.max("image_count").alias("image_count"),
        *[F.sum(c).alias(c) for c in sums], F.max("confusions").alias("confusions"),
        *[exact_round(F.avg(c), 6).alias(c) for c in METRICS],
    )


def metric_deltas(rows: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """For each split and category both models' metrics, and the candidate's gain, absolute and in per cent."""
    side = lambda model, name: rows.where(F.col("model_name") == model).select(
        "split", "category", *[F.col(m).alias(f"{m}_{name}") for m in METRICS]
    )
    both = side(baseline, "baseline").join(side(candidate, "candidate"), ["split", "category"])
    out: list[Column] = []
    for m in METRICS:
        a, b = F.col(f"{m}_baseline"), F.col(f"{m}_candidate")
        out += [
            a, b, exact_round(b - a, 6).alias(f"{m}_absolute_delta"),
            F.when(a != 0, exact_round((b - a) / a * 100, 3)).alias(f"{m}_relative_percent"),
        ]
    return both.select(
        "split", "category", F.lit(baseline).alias("baseline_model"), F.lit(candidate).alias("candidate_model"), *out
    )


def diagnostic_aggregates(rows: DataFrame) -> DataFrame:
    """For each model and category the splits' plain mean, and scores of their pooled counts (without AP)."""
    by = ["model_name", "category"]
    mean = rows.groupBy(*by).agg(F.lit("equal_split_average").alias("aggregation"), *[exact_round(F.avg(m), 6).alias(m) for m in METRICS])
    pooled = scored(rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))
    pooled = pooled.select(
        *by, F.lit("pooled_counts").alias("aggregation"), *METRICS[:4],
        *[F.lit(None).cast("double").alias(m) for m in METRICS[4:]],
    )
    return mean.unionByName(pooled)


def pr_curve_points(sweep: DataFrame) -> DataFrame:
    """Points of precision-recall and F-score charts."""
    return scored(sweep).select("split", "model_name", "category", "threshold", "precision", "recall", "f1", "f2")
