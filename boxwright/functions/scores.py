"""Precision, recall and F scores as column expressions; a zero denominator gives 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def fbeta(p: Column, r: Column, beta: float) -> Column:
    b = F.lit(beta * beta)
    return ratio((b + 1) * p * r, b * p + r)
