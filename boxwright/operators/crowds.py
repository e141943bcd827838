"""Matching in crowded images, where an image is no longer one row: tiles, a grid inside crowded tiles, edges taken in rounds.

Two boxes whose overlap (intersection over union) is at least t have widths, and heights, within a factor 1 / t of each other,
and centres no further apart than their sizes allow. So an image is dealt out in tiles, by its boxes' size (in levels of a factor of 16) and
place: a ground-truth box lies in one tile, and a prediction in the tiles that may hold a box of enough overlap. Tiles are several
times as wide as their boxes, so that is one tile for most predictions and a row moves about once. A tile is then what an image is elsewhere: one row
with its boxes as arrays.

A tile with too many pairs is split further by a finer grid: ground-truth boxes lie in cells of their size class (a class is a
factor of 1 / t in width and in height), and a prediction looks into the few cells of the few classes that may hold a box of enough
overlap. Each pair meets once, in a join on tile, class and cell: no image is one task, and pairs far apart never meet.

The greedy walk takes edges in a total order, so an edge that comes first at both of its ends is taken whatever happens elsewhere. The walk in
a tile takes what can't depend on other tiles. Edges of predictions that lie in several tiles, edges that wait for these, and those of
crowded tiles are taken in rounds: each takes all edges that are first at both ends and drops those that share an end with
them. The result is that of the walk. Rounds end when no edge is left. What is kept on the way are compressed tables in the checkpoint folder.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxwright.functions.geometry import area, corners, iou
from boxwright.operators.matching import CONFUSION, FALSE_NEGATIVE, FALSE_POSITIVE, TRUE_POSITIVE, confident, edges, image_rows
from boxwright.sources.scratch import cut, drop_stored, stored

#: Pairs of a prediction and a box from which an image, or a tile, is crowded.
CROWDED = 1 << 20
#: Factor between the sizes of a level of tiles, and how many times as wide as the largest box of its level a tile is.
_LEVEL, _WIDE = 16, 4
_BOX = ("x1", "y1", "x2", "y2")
_SIDES = {"x": ("x1", "x2"), "y": ("y1", "y2")}
_EPS = 1e-9


def crowded_images(ground_truth: DataFrame, predictions: DataFrame, pairs: int = CROWDED, key: str = "image_id") -> DataFrame:
    """Keys of images whose predictions (of all models) times boxes are more than `pairs`."""
    count = lambda df, g, p: df.select(key, F.lit(g).alias("g"), F.lit(p).alias("p"))
    both = count(ground_truth, 1, 0).unionByName(count(predictions, 0, 1))
    return both.groupBy(key).agg(F.sum("g").alias("g"), F.sum("p").alias("p")).where(F.col("g") * F.col("p") > pairs).select(key)


def _reach(least: float) -> float:
    """The distance of two centres, in widths of the wider box, up to which boxes may overlap enough."""
    return max(1 - least, 0.5, 0.5 / least if least < 0.5 else 0.0) * (1 + _EPS)


def _size(side: str) -> Column:
    a, b = _SIDES[side]
    return F.col(b) - F.col(a)


def _centre(side: str) -> Column:
    a, b = _SIDES[side]
    return (F.col(a) + F.col(b)) / 2


def _extent() -> Column:
    return (_size("x") > 0) & (_size("y") > 0)


def _in_tiles(df: DataFrame, least: float, by: Sequence[str], several: bool) -> DataFrame:
    """df with `tile`, a struct of `by` and a level and a place along either axis; boxes without an extent have a tile too.

    several: a row for each tile in which a partner may lie, `own` for one of them, `open` if there are more; else the tile of the box itself.
    """
    log = lambda c: F.log(c) / math.log(_LEVEL)
    widest = lambda k: F.pow(F.lit(float(_LEVEL)), k + 1)  # noqa: E731  no box of level k is wider
    place = lambda c, k: F.floor(c / (widest(k) * _WIDE * max(1.0, _reach(least))))

    def along(s: str) -> Column:
        size, centre = _size(s), _centre(s)
        one = lambda k: F.struct(k.alias("level"), place(centre, k).alias("place"))
        level = F.when(_extent(), F.floor(log(size))).otherwise(F.lit(0).cast("long"))
        if not several:
            return F.array(one(level))

        def of_level(k: Column) -> Column:
            # no partner's centre is further off: it is of size s / least at most, and covers the share `least` of the wider one
            far = F.least(size * max(1 - least, (1 / least - 1) / 2), (size + widest(k)) / 2)
            far = far * (1 + _EPS) + F.abs(centre) * 1e-12
            return F.transform(F.sequence(place(centre - far, k), place(centre + far, k)), lambda n: F.struct(k.alias("level"), n.alias("place")))

        levels = F.sequence(F.floor(log(size * least) - _EPS), F.floor(log(size / least) + _EPS))
        return F.when(_extent(), F.flatten(F.transform(levels, of_level))).otherwise(F.array(one(level)))

    tile = lambda x, y: F.struct(*by, *[v[f].alias(f"{s}_{f}") for s, v in (("x", x), ("y", y)) for f in ("level", "place")])
    if not several:
        return df.withColumn("tile", tile(F.get(along("x"), F.lit(0)), F.get(along("y"), F.lit(0))))
    rows = df.withColumns({"_x": along("x"), "_y": along("y")})
    rows = rows.withColumn("_tiles", F.flatten(F.transform("_x", lambda x: F.transform("_y", lambda y: tile(x, y)))))
    rows = rows.select(*df.columns, (F.size("_tiles") > 1).alias("open"), F.posexplode("_tiles").alias("_k", "tile"))
    return rows.withColumn("own", F.col("_k") == 0).drop("_k")


def _cell_pairs(left: DataFrame, right: DataFrame, least: float, by: Sequence[str]) -> DataFrame:
    """Pairs of structs `a` of left and `b` of right, equal in `by`, with an `iou` of at least `least`, by cells of size classes."""
    base = max(1 / least, 1.05)
    reach = _reach(least)  # in widths of the class
    log = lambda c: F.log(c) / math.log(base)
    width = lambda k: F.pow(F.lit(base), k + 1) * (1 + _EPS)  # noqa: E731  no box of class k is wider
    cell = lambda c, k: F.floor(c / (width(k) * 2 * reach))
    homes = right.where(_extent()).select(*by, F.struct(*[F.col(c) for c in right.columns if c not in by]).alias("b"), *_BOX)
    homes = homes.withColumns({f"{s}_class": F.floor(log(_size(s))) for s in _SIDES})
    homes = homes.withColumns({f"{s}_cell": cell(_centre(s), F.col(f"{s}_class")) for s in _SIDES})
    keys = [f"{s}_{what}" for s in _SIDES for what in ("class", "cell")]
    homes = homes.select(*by, "b", *keys)

    def probes(s: str) -> Column:
        """The classes and cells along one axis in which a partner may be."""
        first, last = F.floor(log(_size(s) * least) - _EPS), F.floor(log(_size(s) / least) + _EPS)
        of_class = lambda k: F.transform(
            F.sequence(cell(_centre(s) - width(k) * reach, k), cell(_centre(s) + width(k) * reach, k)),
            lambda c: F.struct(k.alias("class"), c.alias("cell")),
        )
        return F.flatten(F.transform(F.sequence(first, last), of_class))

    seekers = left.where(_extent()).select(*by, F.struct(*[F.col(c) for c in left.columns if c not in by]).alias("a"), *[probes(s).alias(s) for s in _SIDES])
    seekers = seekers.withColumn("x", F.explode("x")).withColumn("y", F.explode("y"))
    seekers = seekers.select(*by, "a", *[F.col(f"{s}.{what}").alias(f"{s}_{what}") for s in _SIDES for what in ("class", "cell")])
    met = seekers.join(homes, [*by, *keys]).select(*by, "a", "b", _overlap(F.col("a"), F.col("b")).alias("iou"))
    return met.where(F.col("iou") >= least)


def _overlap(a: Column, b: Column) -> Column:
    return iou(tuple(a[c] for c in _BOX), tuple(b[c] for c in _BOX))


def _parts(left: DataFrame, right: DataFrame, pairs: int) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame] | None]:
    """Rows of both with a tile: those of usual tiles, and those of tiles with more than `pairs` pairs, if there are any (a job finds out)."""
    crowd = stored(crowded_images(right, left, pairs, "tile"))
    if crowd.isEmpty():
        drop_stored(crowd)
        return (left, right), None
    part = lambda how: (left.join(crowd, "tile", how), right.join(crowd, "tile", how))
    return part("left_anti"), part("left_semi")


def grid_pairs(left: DataFrame, right: DataFrame, least: float, by: Sequence[str] = ("image_id",), pairs: int = CROWDED) -> DataFrame:
    """Pairs of structs `a` of left and `b` of right, equal in `by`, with an `iou` of at least `least`, which is above 0.

    The rows of both have x1, y1, x2, y2; each pair that reaches `least` is found, once. Jobs keep both and count the pairs of tiles.
    """
    if not 0 < least <= 1:
        raise ValueError("a grid needs an overlap above 0 and of at most 1")
    a_columns, b_columns = ([c for c in df.columns if c not in by] for df in (left, right))
    left, right = stored(left.where(_extent())), stored(right.where(_extent()))
    left, right = _in_tiles(left, least, by, True).drop("own", "open"), _in_tiles(right, least, by, False)
    usual, crowd = _parts(left, right, pairs)
    rows = lambda df, columns, name: df.groupBy("tile").agg(F.collect_list(F.struct(*columns)).alias(name))
    meet = lambda x, y, s: F.least(x[s[1]], y[s[1]]) > F.greatest(x[s[0]], y[s[0]])
    near = lambda x: F.transform(
        F.filter("_b", lambda y: meet(x, y, _SIDES["x"]) & meet(x, y, _SIDES["y"]) & (_overlap(x, y) >= least)),
        lambda y: F.struct(x.alias("a"), y.alias("b"), _overlap(x, y).alias("iou")),
    )
    met = rows(usual[0], a_columns, "_a").join(rows(usual[1], b_columns, "_b"), "tile")
    met = met.select("tile", F.explode(F.flatten(F.transform("_a", near))).alias("e"))
    found = met.select(*[F.col(f"tile.{c}").alias(c) for c in by], "e.a", "e.b", "e.iou")
    if crowd is None:
        return found
    mine = lambda df, columns: df.select("tile", *columns)
    more = _cell_pairs(mine(crowd[0], a_columns), mine(crowd[1], b_columns), least, ["tile"])
    return found.unionByName(more.select(*[F.col(f"tile.{c}").alias(c) for c in by], "a", "b", "iou"))


def taken_in_rounds(edges: DataFrame, left: Sequence[str], right: Sequence[str], order: Sequence[str], rounds: int = 10_000) -> DataFrame:
    """The edges that a greedy walk in ascending `order`, a total order within connected edges, takes; an end only once.

    left, right: the columns that tell an edge's ends.
    """
    rank = F.struct(*order)
    at_left, at_right = Window.partitionBy(*left), Window.partitionBy(*right)
    now, done = stored(edges), []
    for _ in range(rounds):
        if now.isEmpty():
            break
        judged = now.withColumn("_first", F.min(rank).over(at_left) == rank)
        judged = judged.withColumn("_taken", F.col("_first") & (F.min(rank).over(at_right) == rank))
        judged = judged.withColumn("_gone", F.max("_taken").over(at_right))
        judged = stored(judged.withColumn("_gone", F.col("_gone") | F.max("_taken").over(at_left)))
        drop_stored(now)
        done.append(stored(judged.where("_taken").select(edges.columns)))
        now = judged.where("not _gone").select(edges.columns)
    else:
        raise RuntimeError(f"edges are left after {rounds} rounds")
    drop_stored(now)
    if not done:
        return edges.sparkSession.createDataFrame([], edges.schema)
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def match_crowds(
    ground_truth: DataFrame, predictions: DataFrame, models: Sequence[str], threshold: float = 0.0, least: float = 0.5,
    key: str = "image_id", confusions: bool = True, pairs: int = CROWDED,
) -> DataFrame:
    """matching.match() for images of any number of boxes: the same rows, found in tiles and in rounds. Runs jobs at once."""
    if not 0 < least <= 1:
        raise ValueError("a grid needs an overlap above 0 and of at most 1")
    p_columns, g_columns = ("det_pos", "confidence", "category", *_BOX), ("ann_ord", "annotation_id", "category", *_BOX)
    found = stored(confident(predictions, threshold).where(F.col("model_name").isin(*models)).select(key, "model_name", *p_columns))
    truth = stored(ground_truth.select(key, *g_columns))
    usual, crowd = _parts(_in_tiles(found, least, [key], True), _in_tiles(truth, least, [key], False), pairs)
    walked = stored(_walked(usual[1], usual[0], models, least, confusions))
    if crowd is None:
        drop_stored(found, truth)
    each = walked.select(F.col(f"tile.{key}").alias(key), "model_name", F.explode(_judged()).alias("m")).select(key, "model_name", "m.*")
    over = F.col("kind").isin("edge", "p", "g")
    waiting = stored(each.where(over))
    edge = lambda p, g, share, more: (
        key, F.col(f"{p}.category").alias("p_category"), F.col(f"{g}.category").alias("g_category"), *more,
        F.col(f"{p}.confidence").alias("confidence"), F.col(f"{p}.det_pos").alias("det_pos"), share.alias("iou"), F.col(f"{g}.ann_ord").alias("ann_ord"),
    )
    open_edges = waiting.where("kind = 'edge'").select(*edge("p", "g", F.col("iou"), ["model_name"]))
    place, size = F.lit(None).cast("int").alias("i"), area(corners()).alias("area")
    as_p, as_g = F.struct(place, *p_columns, size).alias("p"), F.struct(place, *g_columns, size).alias("g")
    bare = lambda name, columns: F.when(
        F.col(name).isNotNull(), F.struct(place, *[F.col(f"{name}.{c}").alias(c) for c in columns], F.col(f"{name}.area").alias("area"))
    ).alias(name)
    p_rows = waiting.where("kind = 'p'").select(key, "model_name", F.col("p.det_pos").alias("det_pos"), bare("p", p_columns))
    g_rows = waiting.where("kind = 'g'").select(key, "model_name", F.col("g.ann_ord").alias("ann_ord"), bare("g", g_columns))
    if crowd is not None:
        met = _cell_pairs(crowd[0].select("tile", "model_name", *p_columns), crowd[1].select("tile", *g_columns), least, ["tile"])
        met = met.select(F.col(f"tile.{key}").alias(key), "a", "b", "iou").where(F.lit(confusions) | (F.col("a.category") == F.col("b.category")))
        open_edges = open_edges.unionByName(met.select(*edge("a", "b", F.col("iou"), [F.col("a.model_name").alias("model_name")])))
        p_rows = p_rows.unionByName(crowd[0].where("own").select(key, "model_name", "det_pos", as_p))
        more = crowd[1].withColumn("model_name", F.explode(F.array(*map(F.lit, models))))
        g_rows = g_rows.unionByName(more.select(key, "model_name", "ann_ord", as_g))
    same = F.col("p_category") == F.col("g_category")
    open_edges = open_edges.select(
        key, "model_name", F.when(same, 1).otherwise(2).alias("phase"), (-F.col("confidence")).alias("order"), "det_pos",
        (-F.col("iou")).alias("back"), "ann_ord",
    )
    p_key, g_key = [key, "model_name", "det_pos"], [key, "model_name", "ann_ord"]
    taken = taken_in_rounds(open_edges, p_key, g_key, ["phase", "order", "det_pos", "back", "ann_ord"])
    taken = taken.select(*p_key, "ann_ord", "phase", "back")
    rows = p_rows.join(taken, p_key, "left").join(g_rows, g_key, "full")
    kind = (
        F.when(F.col("p").isNull(), FALSE_NEGATIVE).when(F.col("phase").isNull(), FALSE_POSITIVE)
        .when(F.col("phase") == 1, TRUE_POSITIVE).otherwise(CONFUSION)
    )
    rows = rows.select(key, "model_name", kind.alias("kind"), "p", "g", (-F.col("back")).alias("iou"))
    sure = each.where(~over).select(key, "model_name", "kind", bare("p", p_columns), bare("g", g_columns), "iou")
    return sure.unionByName(rows).select(
        key, "model_name", F.col("kind").alias("match_type"), F.coalesce("g.category", "p.category").alias("category"),
        F.col("p.category").alias("predicted_category"), F.col("p.confidence").alias("confidence"), "iou",
        F.col("p.det_pos").alias("det_pos"), F.col("g.annotation_id").alias("annotation_id"), "p", "g",
    )


def _walked(homes: DataFrame, seekers: DataFrame, models: Sequence[str], least: float, confusions: bool) -> DataFrame:
    """A row for each tile and model: its boxes p and g, the edges `taken`, and those `left` that hang on other tiles.

    In order, an edge of which an end is taken is dropped. One is left if its prediction lies in several tiles, or if an end waits for an edge
    that is left; else it is taken. Ends that wait are in the fold as edges of phase 0.
    """
    rows = image_rows(homes, seekers, models, "tile", more_p=("open", "own"))
    same = lambda p, g: p["category"] == g["category"]
    phase = lambda p, g, overlap: F.when(
        F.lit(confusions) | same(p, g), F.array(F.when(same(p, g), 1).otherwise(2))
    ).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("edges", edges("p", "g", least, phase))
    rows = rows.withColumn("_open", F.transform(F.filter("p", lambda x: x["open"]), lambda x: x["i"]))
    none = F.expr("cast(array() as array<struct<phase:int,i:int,back:double,j:int>>)")

    def step(seen: Column, e: Column) -> Column:
        shares = lambda t: (t["i"] == e["i"]) | (t["j"] == e["j"])
        i_waits = F.exists(seen, lambda t: (t["phase"] == 0) & (t["i"] == e["i"]))
        j_waits = F.exists(seen, lambda t: (t["phase"] == 0) & (t["j"] == e["j"]))
        waits = F.struct(F.lit(0).alias("phase"), e["i"].alias("i"), F.lit(0.0).alias("back"), e["j"].alias("j"))
        return (
            F.when(F.exists(seen, lambda t: (t["phase"] > 0) & shares(t)), seen).when(i_waits & j_waits, seen)
            .when(i_waits | j_waits | F.array_contains("_open", e["i"]), F.array_append(seen, waits)).otherwise(F.array_append(seen, e))
        )

    rows = rows.withColumn("taken", F.filter(F.aggregate("edges", none, step), lambda t: t["phase"] > 0))
    # edges that share an end with one that is taken are dropped: none of these comes before it and waits, or it would wait too
    at = lambda end: F.transform("taken", lambda t: t[end])
    rows = rows.withColumns({"_i": at("i"), "_j": at("j")})
    left = F.filter("edges", lambda e: ~F.array_contains("_i", e["i"]) & ~F.array_contains("_j", e["j"]))
    return rows.select("tile", "model_name", "p", "g", "taken", left.alias("left"))


def _judged() -> Column:
    """What is known of a walked row: kind (a type of match, `edge` for edges left, p and g for boxes that wait), p, g and iou."""
    out = lambda kind, p, g, share: F.struct(kind.alias("kind"), p.alias("p"), g.alias("g"), share.alias("iou"))
    no = lambda name: F.get(name, F.lit(-1))
    no_iou = F.lit(None).cast("double")
    has = lambda column, end, x: F.exists(column, lambda t: t[end] == x["i"])
    pair = lambda kind: lambda t: out(kind(t), F.get("p", t["i"]), F.get("g", t["j"]), -t["back"])
    pairs = F.transform("taken", pair(lambda t: F.when(t["phase"] == 1, TRUE_POSITIVE).otherwise(CONFUSION)))
    open_pairs = F.transform("left", pair(lambda t: F.lit("edge")))
    free_p = F.filter("p", lambda x: ~x["open"] & ~has("taken", "i", x) & ~has("left", "i", x))
    wait_p = F.filter("p", lambda x: F.when(x["open"], x["own"]).otherwise(has("left", "i", x)))
    free_g = F.filter("g", lambda x: ~has("taken", "j", x) & ~has("left", "j", x))
    wait_g = F.filter("g", lambda x: has("left", "j", x))
    only_p = lambda kind, boxes: F.transform(boxes, lambda x: out(F.lit(kind), x, no("g"), no_iou))
    only_g = lambda kind, boxes: F.transform(boxes, lambda x: out(F.lit(kind), no("p"), x, no_iou))
    return F.concat(
        pairs, open_pairs, only_p(FALSE_POSITIVE, free_p), only_p("p", wait_p), only_g(FALSE_NEGATIVE, free_g), only_g("g", wait_g)
    )


def match_any(
    ground_truth: DataFrame, predictions: DataFrame, models: Sequence[str], threshold: float = 0.0, least: float = 0.5,
    key: str = "image_id", confusions: bool = True, pairs: int = CROWDED,
) -> DataFrame:
    """match() for most images, each one row, and match_crowds() for crowded ones, if there are any (a job finds out)."""
    from boxwright.operators.matching import match

    arguments = (models, threshold, least, key, confusions)
    crowd = cut(crowded_images(ground_truth, predictions, pairs, key))
    if least <= 0 or crowd.isEmpty():
        return match(ground_truth, predictions, *arguments)
    part = lambda how: (ground_truth.join(crowd, key, how), predictions.join(crowd, key, how))
    return match(*part("left_anti"), *arguments).unionByName(match_crowds(*part("left_semi"), *arguments, pairs))
