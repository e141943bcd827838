"""Order statistics and pages against sorted lists."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxwright.operators import order


def test_order_statistics(spark):
    """Groups of one value, of equal values, of values over many orders of magnitude, and a null group."""
    rng = random.Random(2)
    groups = {"one": [3.5], "equal": [2.0] * 50, None: [1.0, 2.0], "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(500)],
              "far": [-1.7e308, 1.7e308, 0.0], "ties": [float(rng.randint(0, 9)) for _ in range(999)], "close": [1 + k * 2.0**-52 for k in range(40)]}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("one", None), ("one", float("nan")), ("none", None)]
    rng.shuffle(rows)
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = order.order_statistics(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", shares).collect()
    assert {r.g: r.n for r in got} == {g: len(v) for g, v in groups.items()}
    for r in got:
        values = sorted(groups[r.g])
        for k, s in enumerate(shares):
            at = s * (len(values) - 1)
            low, high = values[int(np.floor(at))], values[int(np.ceil(at))]
            assert r[f"q{k}"] == (low if at == int(at) else (np.ceil(at) - at) * low + (at - np.floor(at)) * high)


@pytest.mark.parametrize("partitions", [1, 6])
def test_pages(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        names = [f"n{k:03d}" for k in range(200)]
        rows = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "name string, k int").repartition(3)
        pages = order.Pages(rows, F.desc("name"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for start, limit in ((0, 5), (95, 40), (190, 50), (199, 1), (200, 5), (0, 0)):
        page = pages.page(start, limit)
        assert page.columns == ["name", "k"] and [r.name for r in page.collect()] == names[::-1][start : start + limit]
    # a page near the end is read from its own ranges only
    if partitions > 1:
        assert len(pages.page(190, 10).inputFiles()) >= 1 and len(pages.counts) > 3
        plan = pages.page(190, 10)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(_range#" in plan
    assert order.Pages(rows.limit(0), "name").page(0, 5).collect() == []
