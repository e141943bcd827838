"""Rounding, metric rows, average precision, crowded images and split documents against plain Python."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxwright.functions.media import nal_types, nal_types_of
from boxwright.functions.rounding import exact_round
from boxwright.operators import crowds, evaluation, matching, validate
from boxwright.operators.average_precision import average_precision
from boxwright.plans import compare
from boxwright.sources import files, json_split
from test_core import BOX, GT, IM, PR, L, R, plain_match


def test_exact_round(spark, tmp_path):
    """A million means, ratios and differences, and odd values, against round()."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(1)
    a, b = np.round(rng.random(400_000), 6), np.round(rng.random(400_000), 6)
    k, m = rng.integers(0, 400, 300_000), rng.integers(1, 400, 300_000)
    odd = [0.0, -0.0, 1e300, -1e300, 4.6e9 + 1 / 3, 8.6e9 + 0.3, 5e-7, 1.5e-6, 2.5e-6, -2.5e-6, 1e-20, -1e-9, 5e15, 0.7196405]
    v = np.concatenate([(a + b) / 2, k / m, b - a, np.arange(20_000) / 128, odd])
    pq.write_table(pa.table({"v": v}), tmp_path / "v.parquet")
    df = spark.read.parquet(str(tmp_path / "v.parquet"))
    for places in (6, 4, 0):
        rows = df.select("v", exact_round(F.col("v"), places).alias("r"), exact_round(F.col("v"), places, plain=True).alias("p")).toArrow()
        want = np.array([round(x, places) for x in rows["v"].to_pylist()])
        assert (rows["r"].to_numpy() == want).all() and (rows["p"].to_numpy() == want).all()
    values = [None, float("inf"), float("-inf")]
    rows = spark.createDataFrame([(x,) for x in values], "v double").select(exact_round(F.col("v"), 6)).collect()
    assert [r[0] for r in rows] == values


def random_boxes(rng, n, classes=(L, R)):
    def box():
        x, y = rng.randint(0, 6) * 2.0, rng.randint(0, 4) * 2.0
        return x, y, x + rng.randint(3, 9), y + rng.randint(3, 9)

    return [(rng.choice(classes), box()) for _ in range(n)]


def test_metric_rows(spark):
    """Rows of every split, model and category, the classes' mean of rounded values, and deltas."""
    rng = random.Random(3)
    i_rows, g_rows, p_rows = [], [], []
    for n in range(40):
        split = ("train", "valid", "test")[n % 3]
        i_rows.append((str(n), f"r_frame{n}.jpg", split, 100, 100))
        for k, (c, b) in enumerate(random_boxes(rng, rng.randint(0, 5), (L,) if split == "test" else (L, R))):
            g_rows.append((str(n), k, 100 * n + k, c, *b))
        for m in ("m", "n"):
            for k, (c, b) in enumerate(random_boxes(rng, rng.randint(0, 6))):
                p_rows.append((m, str(n), k, c, rng.choice([0.2, 0.5, 0.5, 0.9]), *b))
    images, g, p = spark.createDataFrame(i_rows, IM), spark.createDataFrame(g_rows, GT), spark.createDataFrame(p_rows, PR)

    def plain(split, model, at):
        """tp, fp, fn and confusions for each category and overall."""
        out = {c: [0, 0, 0, 0] for c in ("overall_micro", L, R)}
        for n in (r[0] for r in i_rows if r[2] == split):
            own = [(r[3], r[4:]) for r in g_rows if r[0] == n]
            found = [(r[3], r[4], r[5:]) for r in p_rows if (r[0], r[1]) == (model, n)]
            for kind, a, b in plain_match(own, found, at, 0.5):
                classes = {"p": found[a][0] if a is not None else None, "g": own[b][0] if b is not None else None}
                for c in out:
                    mine = {s: c == "overall_micro" or x == c for s, x in classes.items() if x}
                    out[c][0] += kind == "tp" and mine["p"]
                    out[c][1] += kind in ("fp", "cc") and mine["p"]
                    out[c][2] += kind in ("fn", "cc") and mine["g"]
                    out[c][3] += kind == "cc" and (mine["p"] or mine["g"])
        return out

    def scores(tp, fp, fn, *_):
        a, b = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
        f = lambda x: (1 + x) * a * b / (x * a + b) if x * a + b else 0.0
        return [round(v, 6) for v in (a, b, f(1.0), f(4.0))]

    rows = evaluation.evaluation_rows(images, g, p, ["m", "n"], 0.4)
    got = {(r.split, r.model_name, r.category): r for r in rows.collect()}
    want = {}
    for split in ("train", "valid", "test"):
        for model in ("m", "n"):
            counts = plain(split, model, 0.4)
            for c, found in counts.items():
                want[split, model, c] = [*found, *scores(*found)]
            a, b = want[split, model, L], want[split, model, R]
            want[split, model, "macro_classes"] = [*(x + y for x, y in zip(a[:3], b[:3], strict=True)), max(a[3], b[3]), *(round(sum((x, y)) / 2, 6) for x, y in zip(a[4:], b[4:], strict=True))]
    names = ("tp", "fp", "fn", "confusions", "precision", "recall", "f1", "f2")
    assert {k: [getattr(r, n) for n in names] for k, r in got.items()} == want
    for d in evaluation.metric_deltas(rows, "m", "n").collect():
        for at, name in enumerate(names[4:], 4):
            a, b = want[d.split, "m", d.category][at], want[d.split, "n", d.category][at]
            assert d[f"{name}_absolute_delta"] == round(b - a, 6)
            assert d[f"{name}_relative_percent"] == (round((b - a) / a * 100, 3) if a else None)
    # the test split has no box of one class: all of its thresholds are there, with false positives
    sweep = evaluation.threshold_sweep(images, g, p, ["m", "n"])
    lines = {(r.split, r.model_name, r.category, r.threshold): [r.tp, r.fp, r.fn] for r in sweep.collect()}
    for split in ("valid", "test"):
        for at in (0.0, 0.2, 0.5, 0.9, 1.0):
            for c, found in plain(split, "m", at).items():
                if (split, "m", c, at) in lines:
                    assert lines[split, "m", c, at] == found[:3]
    assert lines["test", "m", R, 0.0][1] > 0 and lines["test", "m", R, 1.0] == [0, 0, 0]


def test_categories(spark):
    rows = spark.createDataFrame([("a", L), ("a", "foot"), ("a", None), ("b", R)], "split string, category string")
    listed = spark.createDataFrame([("a", L), ("a", R), ("a", "foot"), ("a", "hands"), ("b", R), ("b", "left")], "split string, category string")
    got = sorted(map(tuple, validate.category_violations(rows, listed).collect()), key=str)
    assert got == [("a", "foot", 1, "unsupported"), ("a", None, 1, "unsupported"), ("b", L, 0, "missing")]


def plain_ap(images, g, p, t):
    """Precision at 101 recall points of one class; g: image, box, crowd; p: image, score, box; sorted as they come."""
    found, total = [], sum(not x[2] for x in g)
    for image in images:
        own = [x for x in g if x[0] == image]
        taken = set()
        mine = sorted(((k, x) for k, x in enumerate(p) if x[0] == image), key=lambda kx: -kx[1][1])[:100]
        for place, (_, (_, score, box)) in enumerate(mine):
            best, at, out = min(t, 1 - 1e-10), None, False
            for crowd in (False, True):
                for j, (_, b, c) in enumerate(own):
                    if c != crowd or (j in taken and not c) or (crowd and at is not None):
                        continue
                    w, h = max(0.0, min(box[2], b[2]) - max(box[0], b[0])), max(0.0, min(box[3], b[3]) - max(box[1], b[1]))
                    size = lambda x: (x[2] - x[0]) * (x[3] - x[1])
                    share = w * h / (size(box) if crowd else size(box) + size(b) - w * h)
                    if not crowd and share >= best:
                        best, at = share, j
                    elif crowd and share >= min(t, 1 - 1e-10):
                        out = True
            if at is not None:
                taken.add(at)
            found.append((-score, image, place, at is not None, at is None and out))
    tp = fp = 0
    curve = []
    for _, _, _, hit, out in sorted(found):
        if out:
            continue
        tp, fp = tp + hit, fp + (not hit)
        curve.append((tp / total, tp / (tp + fp)))
    points = [max((q for r, q in curve if r >= k * 0.01), default=0.0) for k in range(101)]
    return sum(points) / 101


@pytest.mark.parametrize("partitions", [4, 9])
def test_average_precision_of_many_images(spark, partitions):
    """Ties of confidence and of overlap, crowds, an image with over 100 detections, a class without boxes, several ranges."""
    rng = random.Random(partitions)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    i_rows, g_rows, p_rows = [], [], []
    for n in range(30):
        image = f"{n:02d}"
        i_rows.append((image, f"r_frame{n}.jpg", "valid", 100, 100))
        for k, (c, b) in enumerate(random_boxes(rng, rng.randint(0, 5), (L,))):
            g_rows.append((image, k, 100 * n + k, c, *b, int(rng.random() < 0.25)))
        for k, (c, b) in enumerate(random_boxes(rng, 130 if n == 7 else rng.randint(0, 6), (L, L, R))):
            p_rows.append(("m", image, k, c, rng.choice([0.2, 0.5, 0.5, 0.9]), *b))
    images, g, p = spark.createDataFrame(i_rows, IM), spark.createDataFrame(g_rows, GT + ", iscrowd int"), spark.createDataFrame(p_rows, PR)
    try:
        rows = {r.category: r for r in average_precision(images, g, p, ["m", "none"]).where("model_name = 'm'").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert set(rows) == {L, "overall_micro"}
    own = ([r[0] for r in i_rows], [(r[0], r[4:8], r[8]) for r in g_rows], [(r[1], r[4], r[5:]) for r in p_rows if r[3] == L])
    each = [plain_ap(*own, round(0.5 + 0.05 * k, 2)) for k in range(10)]
    assert rows[L].ap50 == pytest.approx(each[0], abs=1e-9) and rows[L].ap75 == pytest.approx(each[5], abs=1e-9)
    assert rows[L].map_50_95 == pytest.approx(sum(each) / 10, abs=1e-9)


@pytest.mark.parametrize("least", [0.1, 0.5, 0.8])
def test_crowded_image(spark, least):
    """One image with hundreds of boxes of all sizes, against two greedy passes over lists."""
    rng = random.Random(int(least * 10))

    def box(size):
        x, y = rng.randint(0, 200), rng.randint(0, 200)
        return float(x), float(y), x + size * rng.uniform(0.7, 1.4), y + size * rng.uniform(0.7, 1.4)

    sizes = [rng.choice([1, 5, 8, 16, 31, 64, 200]) for _ in range(300)]
    g = [(rng.choice([L, R]), box(s)) for s in sizes] + [(L, (5.0, 5.0, 5.0, 9.0))]
    near = lambda b: tuple(x + rng.choice([0.0, 0.0, 0.4, -1.0]) for x in b)
    p = [(rng.choice([L, R]), rng.choice([0.2, 0.5, 0.5, 0.9]), near(rng.choice(g)[1])) for _ in range(300)]
    p = [x for x in p if x[2][2] > x[2][0] and x[2][3] > x[2][1]]
    g_df = spark.createDataFrame([("a", k, k, c, *b) for k, (c, b) in enumerate(g)], GT)
    p_df = spark.createDataFrame([("m", "a", k, c, s, *b) for k, (c, s, b) in enumerate(p)], PR)
    short = {"true_positive": "tp", "class_confusion": "cc", "false_positive": "fp", "false_negative": "fn"}
    found = crowds.match_any(g_df, p_df, ["m"], 0.3, least, pairs=1000)
    assert sorted(((short[r.match_type], r.det_pos, r.annotation_id) for r in found.collect()), key=str) == plain_match(g, p, 0.3, least)
    usual = matching.match(g_df, p_df, ["m"], 0.3, least)
    rows = lambda df: sorted(str(tuple(r)) for r in df.drop("p", "g").collect())
    assert rows(found) == rows(usual) and found.columns == usual.columns
    assert crowds.crowded_images(g_df, p_df, 10**6).isEmpty()
    with pytest.raises(ValueError, match="above 0"):
        crowds.grid_pairs(p_df, g_df, 0.0)


def shuffled(spark):
    """Rows that the session's stages have shuffled so far."""
    context = spark.sparkContext
    none = context._gateway.new_array(context._jvm.double, 0)
    context._jsc.sc().listenerBus().waitUntilEmpty()
    stages = context._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_crowded_image_moves_a_row_about_once(spark):
    """Boxes of one crowded image go to the tile of their place; so far a prediction was dealt out to a cell for each size and place of a partner."""
    n = 3000
    at = lambda k: (1000.0 * k, 20.0 * (k % 5), 1000.0 * k + 60 + k % 20, 20.0 * (k % 5) + 50 + k % 30)
    g = spark.createDataFrame([("a", k, k, L, *at(k)) for k in range(n)], GT)
    p = spark.createDataFrame([("m", "a", k, L, 0.9, *(x + 1 for x in at(k))) for k in range(n)], PR)
    before = shuffled(spark)
    pairs = crowds.grid_pairs(p, g, 0.5).select("a.det_pos", "b.ann_ord").collect()
    assert sorted(map(tuple, pairs)) == [(k, k) for k in range(n)]
    assert shuffled(spark) - before < 5 * n  # 2 n for the boxes, as many for the counts of tiles
    before = shuffled(spark)
    found = crowds.match_crowds(g, p, ["m"], 0.3)
    assert {(r.match_type, r.det_pos, r.annotation_id) for r in found.collect()} == {("true_positive", k, k) for k in range(n)}
    assert shuffled(spark) - before < 7 * n


@pytest.mark.parametrize("pairs", [1, 50, 10**6])
def test_tiles_that_hang_together(spark, pairs):
    """Chains of boxes across many tiles, boxes of two levels of size, and a second model, as the walk over whole images has them."""
    rng = random.Random(pairs)
    g, p = [], []
    for k in range(400):
        size = rng.choice([14.0, 15.9, 16.1, 40.0, 255.0, 300.0])
        x, y = rng.uniform(-300, 300), rng.uniform(-20, 20)
        g.append(("ab"[k % 2], k, k, rng.choice([L, R]), x, y, x + size, y + size * rng.uniform(0.8, 1.2)))
        for model in "mn":
            dx = size * rng.uniform(-0.3, 0.3)
            p.append((model, "ab"[k % 2], k, rng.choice([L, L, R]), rng.choice([0.3, 0.5, 0.5, 0.9]), x + dx, y, x + dx + size, y + size))
    g_df, p_df = spark.createDataFrame(g, GT), spark.createDataFrame(p, PR)
    rows = lambda df: sorted(str(tuple(r)) for r in df.drop("p", "g").collect())
    found = crowds.match_crowds(g_df, p_df, ["m", "n"], 0.4, 0.5, pairs=pairs)
    assert rows(found) == rows(matching.match(g_df, p_df, ["m", "n"], 0.4, 0.5))
    assert found.where("p is null").count() == found.where("match_type = 'false_negative'").count()


def test_no_crowd_at_all(spark):
    none = matching.match(spark.createDataFrame([], GT), spark.createDataFrame([], PR), ["m"])
    assert none.isEmpty()
    g = spark.createDataFrame([("a", 0, 1, L, *BOX)], GT)
    (row,) = crowds.match_crowds(g, spark.createDataFrame([], PR), ["m"]).collect()
    assert (row.match_type, row.annotation_id, row.iou) == ("false_negative", 1, None)


ODD = ['a"b', "\\", '\\\\"', "{", "}", "[x]", "ü日", "line\nbreak", '\\"]}', ""]


@pytest.mark.parametrize(("seed", "block"), [(0, 37), (1, 101), (2, 500), (3, 1 << 25)])
def test_split_document(spark, tmp_path, seed, block):
    """Ranges that begin anywhere: in strings, in runs of backslashes, between a key and its array."""
    rng = random.Random(seed)
    thing = lambda k: {"id": k, "n": rng.choice(ODD), "bbox": [1, 2.5, [{"z": rng.choice(ODD)}]], rng.choice(ODD) + "k": {"q": [{}]}}
    doc = {"info": {"x": [{"y": 1}], "z": {"w": {}}}, "images": [thing(k) for k in range(40 * (seed % 2))], "licenses": [], "deep": [[{"a": 1}], []],
           "annotations": [thing(k) for k in range(60)], 'n"o': [{"p": 1}], "num": 3, "categories": [thing(k) for k in range(2)]}
    path = tmp_path / "a folder" / "_d.json"
    path.parent.mkdir()
    path.write_text(json.dumps(doc, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5))
    at = json_split.qualified(spark, str(path))
    assert json_split.readable(at) and not json_split.readable("viewfs://store/x.json")
    ranges = json_split.json_ranges(spark, at, path.stat().st_size, block)
    assert ranges.count() == -(-path.stat().st_size // block)
    for name in ("images", "annotations", "categories", 'n\\"o', "deep", "licenses"):
        got = {r.place: json.loads(r.text) for r in json_split.json_objects(ranges, at, name, block).collect()}
        assert got == (dict(enumerate(doc[name.replace("\\", "")])) if name != "deep" else {})
    path.write_text('{"a": [{"b": "c]}')
    with pytest.raises(ValueError, match="whole JSON"):
        json_split.json_ranges(spark, at, 17, 5)


def test_dataset_checks(spark, tmp_path):
    """Splits are read in ranges as by one parse; wrong names, missing categories and missing images are errors."""

    def write(kinds=(L, R), images=2, left_out=""):
        for split in compare.SPLITS:
            folder = tmp_path / split
            folder.mkdir(exist_ok=True)
            names = [f"{split}{k}_frame1.jpg" for k in range(images)]
            doc = {"images": [{"id": k, "file_name": n, "width": 50, "height": 50} for k, n in enumerate(names)],
                   "annotations": [{"id": k, "image_id": k % images, "category_id": 1, "bbox": [0, 0, 9, 9]} for k in range(5)],
                   "categories": [{"id": k + 1, "name": n} for k, n in enumerate(kinds)]}
            (folder / "_annotations.coco.json").write_text(json.dumps(doc))
            for n in names:
                (folder / n).write_bytes(b"x")
                if n == left_out:
                    (folder / n).unlink()
            (tmp_path / "run/predictions/m").mkdir(parents=True, exist_ok=True)
            lines = [json.dumps({"file_name": n, "model_name": "m", "detections": []}) for n in names]
            (tmp_path / f"run/predictions/m/{split}.jsonl").write_text("\n".join(lines))

    load = lambda: compare.load(spark, str(tmp_path), str(tmp_path / "run"), ["m"])
    write()
    images, truth, _ = load()
    assert images.count() == 6 and truth.count() == 15
    small = files.read_coco(spark, str(tmp_path), "valid", block=40)
    whole = files.read_coco(spark, str(tmp_path), "valid")
    for a, b in zip(small, whole, strict=True):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert [r.ann_ord for r in small[1].orderBy("annotation_id").collect()] == list(range(5))
    assert sorted(x.name for x in (tmp_path / "valid").iterdir()) == ["_annotations.coco.json", "valid0_frame1.jpg", "valid1_frame1.jpg"]
    write(kinds=("left", R))
    with pytest.raises(ValueError, match="categories"):
        load()
    write(kinds=(L, "hands"))
    with pytest.raises(ValueError, match="missing"):
        load()
    import hashlib

    image = hashlib.sha256(b"x").hexdigest()
    found = files.file_digests(spark, str(tmp_path / "valid"), "*.jpg").collect()
    assert [(r.path[-16:], r.length, r.sha256) for r in sorted(found)] == [(f"valid{k}_frame1.jpg"[-16:], 1, image) for k in range(2)]
    write(left_out="test1_frame1.jpg")
    with pytest.raises(ValueError, match="missing images"):
        load()


def test_unit_types_in_the_jvm(spark):
    """Random packets of few different bytes, so that start codes overlap and stand at the ends, and of all bytes."""
    rng = random.Random(5)
    packets = [bytes(rng.choice([0, 0, 0, 1, 1, 0x67, 0x85, 0xFF]) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    packets += [b"", b"\x00\x00\x01", bytes(range(256)), *(b"\x00\x00\x01" + bytes([k]) for k in range(256))]
    rows = spark.createDataFrame([(k, bytearray(p)) for k, p in enumerate(packets)] + [(-1, None)], "k int, p binary")
    got = {r.k: r.t for r in rows.select("k", nal_types(F.col("p")).alias("t")).collect()}
    assert got.pop(-1) is None and got == {k: sorted(nal_types_of(p)) for k, p in enumerate(packets)}
