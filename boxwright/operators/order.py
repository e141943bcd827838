"""Exact order statistics and pages of a sorted table, without one buffer or task that holds a group or all rows before a page."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxwright.sources.scratch import cut, shared_folder

BUCKETS = 1024
#: Rows of targets up to which they are sent to all tasks.
FEW = 100_000


def same(left: DataFrame, right: DataFrame, by: Sequence[str]) -> Column:
    """Equal in `by`, null to null."""
    return reduce(Column.__and__, [left[c].eqNullSafe(right[f"_{c}"]) for c in by])


def keyed(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"_{c}" for c in by})


def _scale(v: Column) -> Column:
    """A value's logarithm on its side of 0, in the order of values."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log(F.abs(v)) + 800))


def order_statistics(rows: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """by, n (values that aren't null), and q0, q1, ...: the value at each share of the way from the least to the largest, between neighbours in proportion.

    Exact, by narrowing histograms: each pass counts the values between a target's bounds in BUCKETS equal parts and goes on with the
    part that has its rank, until a part holds one value. So a group is BUCKETS rows of each task at most, whatever its size. Runs jobs.
    NaN counts as no value; groups without a value have no row.
    """
    v = F.col("_v")
    values = cut(rows.select(*by, F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("_v")).where("_v is not null"))
    at = lambda n, share: F.lit(float(share)) * (n - 1)
    places = lambda n: F.array(*[f(at(n, s)).cast("long") for s in shares for f in (F.floor, F.ceil)])
    ends = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    now = cut(ends.select(*by, "n", F.explode(F.array_distinct(places(F.col("n")))).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("before")))
    while (open_ := now.where("lo < hi").count()) > 0:
        todo = keyed(now.where("lo < hi"), by)
        todo = F.broadcast(todo) if open_ <= FEW else todo
        met = values.join(todo, same(values, todo, by)).where(v.between(F.col("lo"), F.col("hi")))
        lo, hi = F.col("lo"), F.col("hi")
        # bounds of different size or sign are narrowed by logarithms; halves, so that the distance of far bounds is finite
        far = (_scale(v) - _scale(lo)) / (_scale(hi) - _scale(lo))
        part = F.floor(F.when(_scale(hi) - _scale(lo) > 2, far).otherwise((v / 2 - lo / 2) / (hi / 2 - lo / 2)) * BUCKETS)
        target = [*by, "n", "rank", "before"]
        counts = met.groupBy(*target, F.least(F.lit(BUCKETS - 1), part).alias("part")).agg(F.count(F.lit(1)).alias("m"), F.min(v).alias("lo"), F.max(v).alias("hi"))
        earlier = Window.partitionBy(*target).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.col("before") + F.coalesce(F.sum("m").over(earlier), F.lit(0)))
        found = counts.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("m")))
        now = cut(now.where("lo >= hi").unionByName(found.select(now.columns)))
    known = now.groupBy(*by, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("_at"))
    out = [*by, "n"]
    for k, s in enumerate(shares):
        place = at(F.col("n"), s)
        low, high = (F.element_at("_at", f(place).cast("long")) for f in (F.floor, F.ceil))
        between = (F.ceil(place) - place) * low + (place - F.floor(place)) * high
        out.append(F.when(F.floor(place) == F.ceil(place), low).otherwise(between).alias(f"q{k}"))
    return known.select(*out)


class Pages:
    """A table in an order, as ranges of it in the shared folder with their counts: any page is read from the few ranges that it lies in."""

    def __init__(self, rows: DataFrame, *order: Column | str) -> None:
        self.order, spark = order, rows.sparkSession
        path = f"{shared_folder(spark)}/boxwright-pages-{uuid.uuid4().hex}"
        ranged = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
        ranged.write.partitionBy("_range").parquet(path)
        kinds = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, _range int"
        self.rows = spark.read.schema(kinds).parquet(path)
        # a row for each range
        self.counts = [(r["_range"], r["count"]) for r in self.rows.groupBy("_range").count().orderBy("_range").collect()]

    def page(self, start: int, limit: int) -> DataFrame:
        """The rows from place `start` on, `limit` of them, in order."""
        here, before = {}, 0
        for number, count in self.counts:
            if before < start + limit and before + count > start:
                here[number] = before
            before += count
        rows = self.rows.where(F.col("_range").isin(list(here)) if here else F.lit(False))
        ahead = F.element_at(F.create_map(*[F.lit(x) for kv in here.items() for x in kv]), F.col("_range")) if here else F.lit(0)
        place = ahead + F.row_number().over(Window.partitionBy("_range").orderBy(*self.order)) - 1
        rows = rows.withColumn("_place", place).where((F.col("_place") >= start) & (F.col("_place") < start + limit))
        return rows.orderBy("_place").drop("_place", "_range")
