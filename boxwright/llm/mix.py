"""Mixing sources to target weights by entropy balancing.

The mix takes each document at a rate between 0 and `cap` copies, the rates of least relative entropy to taking each
once (bounded entropy: of copies taken and copies left) under one constraint for each source, its number of words. They
are exponentially tilted: rate / (cap - rate) grows as exp(lambda * words), with one lambda for each source that makes
the source's expected words its target. The lambdas solve the convex dual by Newton iterations, safeguarded by
bisection. Each iteration is one distributed aggregation over a table of distinct (source, size) pairs and their
counts; the driver only holds one row for each source.

Rates become copies cell by cell: a cell is the documents of one source and size. Within a source, cells are taken from
long to short documents, and each gets the number of copies that brings the words taken so far nearest to those expected
so far, so that errors of long documents are made up by shorter ones. That takes a row for each different size of a source,
however many documents it has. A cell's copies go to its documents evenly, the odd ones by a hash order of id and text. What is put in
order are numbers: each different hash of a cell with the number of its documents, by salts of the hash, so that neither a large cell nor
a large group of equal documents is one task. The place in that order at which a cell's odd copies end is one row for each cell, which
the documents meet by a join: they compare their own place with it. Of the one group of equal documents at that place, some get one more:
these rows are kept with a random salt and numbered by salts.

Lambdas are rounded to a grid, all else is integers and hashes: reruns agree. Null and empty texts have size 0; rows with a null
source are a source of their own, the last one; null and repeated ids and repeated rows are documents of their own, and
which of two rows of equal id, source and text is taken more often makes no difference. Documents of size 0, and sources
without words, have a target of 0 words and are taken once each (0 words). An empty table gives an empty result. Other
columns come back inside a struct, so their names can't clash. The driver holds a row for each source: more than MOST_SOURCES
raise an error (domains of pages are no sources for this operator).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxwright.llm.common import drop_stored, stored

#: Documents of a cell that are put in order at once.
SALT_ROWS = 2000
MOST_SOURCES = 100_000
#: Cells up to which their rows are broadcast; more meet the documents by a shuffle.
MOST_CELLS = 100_000
ITERATIONS = 60


def targets(
    sizes: dict[str | None, int], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2
) -> dict[str | None, float]:
    """Words that each source is to give: shares by weight, none above cap times its size, the excess reshared."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left = share * sum(sizes.values())
    open_ = list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = float(cap * sizes[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def tilts(cells: DataFrame, goal: dict[str | None, float], sizes: dict[str | None, int], cap: int) -> list[tuple]:
    """(source, lambda) for each source: Newton iterations on the dual. cells: source, size, n."""
    spark = cells.sparkSession
    counts = {r["source"]: (r["n"], r["top"]) for r in cells.groupBy("source").agg(F.sum("n").alias("n"), F.max("size").alias("top")).collect()}
    done: dict[str | None, float] = {}
    state: dict[str | None, list[float]] = {}  # lambda, and the bounds it lies between
    for s, size in sizes.items():
        if size == 0 or goal[s] <= 0:
            done[s] = 0.0 if size == 0 else -math.inf
        elif goal[s] >= cap * size * (1 - 1e-12):
            done[s] = math.inf
        else:
            scale = counts[s][0] / size  # 1 / the mean size
            state[s] = [0.0, -700 * scale * max(1.0, counts[s][1] * scale), 700.0]
    for _ in range(ITERATIONS):
        if not state:
            break
        now = spark.createDataFrame([(s, v[0]) for s, v in state.items()], "source string, lam double")
        # one row for each source that isn't solved yet
        joined = cells.where("size > 0").join(F.broadcast(now), cells["source"].eqNullSafe(now["source"])).select(
            cells["source"], "size", "n", "lam"
        )
        x = F.least(F.lit(700.0), F.greatest(F.lit(-700.0), F.col("lam") * F.col("size")))
        p = 1 / (1 + F.exp(-x))
        sums = joined.groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * cap * p).alias("words"),
            F.sum(F.col("n") * F.col("size") * F.col("size") * cap * p * (1 - p)).alias("slope"),
        )
        for r in sums.collect():
            s, v = r["source"], state[r["source"]]
            gap = r["words"] - goal[s]
            if abs(gap) <= max(0.25, 1e-7 * goal[s]):
                done[s] = v[0]
                del state[s]
                continue
            v[2 if gap > 0 else 1] = v[0]
            step = v[0] - gap / r["slope"] if r["slope"] > 0 else math.nan
            v[0] = step if v[1] < step < v[2] else (v[1] + v[2]) / 2
    if state:
        raise RuntimeError(f"sources {sorted(map(str, state))[:5]} are not solved after {ITERATIONS} steps")
    return [(s, round(x, 12) if math.isfinite(x) else x) for s, x in done.items()]


def _copies(cap: int):
    def share_out(pdf: pd.DataFrame) -> pd.DataFrame:
        """Copies of each cell of one source, from long to short documents."""
        pdf = pdf.sort_values("size", ascending=False, kind="stable").reset_index(drop=True)
        size, n, lam = pdf["size"].to_numpy(), pdf["n"].to_numpy(), float(pdf["lam"].iloc[0])
        if math.isinf(lam):
            rate = np.full(len(size), float(cap) if lam > 0 else 0.0)
        else:
            rate = cap / (1 + np.exp(-np.clip(lam * size, -700, 700)))
        wanted = np.cumsum(rate * n * size)
        goal = float(pdf["target"].iloc[0]) if math.isfinite(lam) else float(wanted[-1])
        wanted[-1] = goal
        copies, taken = np.zeros(len(size), np.int64), 0
        for k, (s, c, want, r) in enumerate(zip(size.tolist(), n.tolist(), wanted.tolist(), rate.tolist(), strict=True)):
            if s:
                low, high = c * math.floor(r), c * min(cap, math.floor(r) + 1)
                copies[k] = min(high, max(low, math.floor((want - taken) / s + 0.5)))
            else:
                copies[k] = c
            taken += int(copies[k]) * s
        # what is still missing or too much goes to the shortest documents that can take it
        for k in range(len(size) - 1, -1, -1):
            s = int(size[k])
            if not s or abs(goal - taken) < s / 2:
                if s:
                    break
                continue
            more = min(cap * int(n[k]), max(0, int(copies[k]) + round((goal - taken) / s)))
            taken += (more - int(copies[k])) * s
            copies[k] = more
        return pdf[["source", "size", "n", "source_size", "target"]].assign(rate=rate, all=copies)

    return share_out


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: list[str] | None = None,
) -> DataFrame:
    """`row` (a struct of the columns in `carry`, all of docs if not given), size, source_size, target, rate, copies.

    A row for each row of docs; copies are from 0 to cap.
    """
    spark = docs.sparkSession
    # words are runs of other characters than white space: one more than the stretches between them
    words = F.size(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit("[^ \t-\r]+"), F.lit(0)))
    carried = [F.col(f"`{c}`") for c in (carry or docs.columns)]
    rows = docs.select(
        F.struct(*carried).alias("row"),
        F.col(source_col).cast("string").alias("source"),
        words.cast("long").alias("size"),
        F.xxhash64(F.col(id_col), F.col(id_col).isNull(), F.col(text_col), F.lit(7)).alias("order"),
    )
    light = stored(rows.select("source", "size", "order"), "mix-sizes")
    cells = stored(light.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    sums = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(sums) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sizes = {r["source"]: int(r["size"]) for r in sums}
    goal = targets(sizes, weights, share, cap)
    lams = dict(tilts(cells, goal, sizes, cap))
    per_source = spark.createDataFrame(
        [(s, sizes[s], goal[s], lams[s]) for s in sizes], "source string, source_size long, target double, lam double"
    )
    # one row for each source, at most MOST_SOURCES
    known = cells.join(F.broadcast(per_source), cells["source"].eqNullSafe(per_source["source"])).select(
        cells["source"], "size", "n", "source_size", "lam", "target"
    )
    # a row for each different size: their number is bounded by the longest text, not by the documents
    shares = known.groupBy("source").applyInPandas(
        _copies(cap), "source string, size long, n long, source_size long, target double, rate double, all long"
    )
    shares = stored(shares.withColumn("key", source_key()).drop("source"), "mix-copies")
    by = ["key", "size", "order"]
    # a row for each different document of a cell: how many there are of it, and how many come before it in the cell's order
    orders = light.withColumn("key", source_key()).groupBy(*by).agg(F.count(F.lit(1)).alias("m")).join(shares, ["key", "size"])
    orders = orders.withColumn("salt", salt_of("order", "n"))
    orders = stored(orders.select(*by, "salt", "m", "n", "all"), "mix-orders")
    salts = prefix_counts(orders.groupBy("key", "size", "salt").agg(F.sum("m").alias("m")), ["key", "size"], "salt").drop("m")
    inside = prefix_counts(orders, ["key", "size", "salt"], "order").withColumnRenamed("before", "inside")
    each = F.floor(F.col("all") / F.col("n"))
    odd = F.least(F.col("m"), F.greatest(F.lit(0), F.col("all") - each * F.col("n") - F.col("before") - F.col("inside")))
    ranked = inside.join(salts, ["key", "size", "salt"]).withColumn("odd", odd).where("odd > 0")
    # the last group of a cell that gets odd copies: all before it get one more, all after it none
    edges = ranked.groupBy("key", "size").agg(F.max(F.struct("salt", "order", "m", "odd")).alias("edge"))
    edges = shares.join(edges, ["key", "size"], "left").withColumn("each", each.cast("int"))
    edges = stored(edges.select("key", "size", "n", "source_size", "target", "rate", "each", "edge"), "mix-edges")
    drop_stored(orders)
    # a row for each cell, which sizes bound, is all that the texts meet: they are shuffled only if that is a large table
    few = edges.limit(MOST_CELLS + 1).count() <= MOST_CELLS
    out = rows.withColumn("key", source_key()).join(F.broadcast(edges) if few else edges, ["key", "size"])
    columns = ["row", "size", "source_size", "target", "rate", "copies"]
    place, last = F.struct(salt_of("order", "n").alias("salt"), F.col("order")), F.struct("edge.salt", "edge.order")
    more = (F.col("edge").isNotNull() & (place <= last)).cast("int")
    parted = F.col("edge").isNotNull() & (F.col("edge.odd") < F.col("edge.m"))
    whole = out.where(~(parted & (place == last))).withColumn("copies", F.col("each") + more).select(columns)
    some = edges.where(parted).select(
        "key", "size", "edge.order", "edge.m", "edge.odd", "source_size", "target", "rate", "each"
    )
    if not some.isEmpty():
        # at most one group of a cell: its rows are kept, so that their numbers stay what they are
        part = rows.withColumn("key", source_key()).join(some, by).withColumn("salt", F.floor(F.rand(5) * F.ceil(F.col("m") / SALT_ROWS)).cast("int"))
        part = stored(part, "mix-part")
        ahead = prefix_counts(part.groupBy(*by, "salt").agg(F.count(F.lit(1)).alias("m")), by, "salt").drop("m")
        numbered = part.join(stored(ahead, "mix-ahead"), [*by, "salt"])
        rank = F.col("before") + F.row_number().over(Window.partitionBy(*by, "salt").orderBy("order"))
        numbered = numbered.withColumn("copies", F.col("each") + (rank <= F.col("odd")).cast("int"))
        whole = whole.unionByName(numbered.select(columns))
    for t in (light, cells):
        drop_stored(t)
    return whole


def salt_of(order: str, n: str) -> Column:
    """The salt of a hash, of as many as a cell of n documents has."""
    return F.pmod(order, F.ceil(F.col(n) / SALT_ROWS)).cast("int")


def prefix_counts(counts: DataFrame, by: list[str], order: str) -> DataFrame:
    """counts with `before`, the sum of m over the rows of the same `by` that come earlier in `order`."""
    earlier = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("m").over(earlier), F.lit(0)))


def source_key() -> Column:
    """The source as a key that joins: null is a source like any other."""
    return F.struct(F.col("source").isNull().alias("null"), F.coalesce("source", F.lit("")).alias("source"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row that mix() was given, as often as it has copies."""
    some = mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return some.select("row.*")
