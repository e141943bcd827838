"""Hand cases of the detection operators."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from boxwright.functions import media, names
from boxwright.functions.geometry import corners, iou
from boxwright.operators import average_precision, dataset, evaluation, inference, matching, review, revision, validate
from boxwright.sources import files, mcap, sinks, video

GT = "image_id string, ann_ord int, annotation_id long, category string, x1 double, y1 double, x2 double, y2 double"
PR = "model_name string, image_id string, det_pos int, category string, confidence double, x1 double, y1 double, x2 double, y2 double"
IM = "image_id string, file_name string, split string, width int, height int"
BOX = (0.0, 0.0, 10.0, 10.0)
L, R = "left_hand", "right_hand"


def gt(spark, *rows):
    return spark.createDataFrame([("a", k, k + 1, c, *b) for k, (c, b) in enumerate(rows)], GT)


def pr(spark, *rows):
    return spark.createDataFrame([("m", "a", k, c, s, *b) for k, (c, s, b) in enumerate(rows)], PR)


def images(spark):
    return spark.createDataFrame([("a", "rec_frame000001_0000001500ms_jpg.rf.x.jpg", "valid", 100, 100)], IM)


def counts(spark, g, p, at=0.0):
    found = evaluation.match_counts(matching.match(g, p, ["m"], at)).where("category = 'overall_micro'").collect()
    return tuple(found[0][c] for c in ("tp", "fp", "fn", "confusions")) if found else (0, 0, 0, 0)


def test_matching(spark):
    one = gt(spark, (L, BOX))
    assert counts(spark, one, pr(spark, (L, 0.9, BOX), (L, 0.8, BOX))) == (1, 1, 0, 0)
    assert counts(spark, one, pr(spark, (R, 0.9, BOX))) == (0, 1, 1, 1)
    assert counts(spark, gt(spark, (L, BOX), (R, BOX)), pr(spark).limit(0)) == (0, 0, 2, 0)
    # an overlap of just a half is enough
    assert counts(spark, gt(spark, (L, (0.0, 0.0, 10.0, 20.0))), pr(spark, (L, 0.9, BOX))) == (1, 0, 0, 0)
    assert counts(spark, one, pr(spark, (L, 0.9, BOX)), at=0.95) == (0, 0, 1, 0)
    # ties go to the first ground-truth box
    (row,) = matching.match(gt(spark, (L, BOX), (L, BOX)), pr(spark, (L, 0.5, BOX)), ["m"]).where("match_type = 'true_positive'").collect()
    assert row.annotation_id == 1


def plain_match(g, p, at, least):
    """Two greedy passes over lists."""
    def overlap(a, b):
        w, h = max(0.0, min(a[2], b[2]) - max(a[0], b[0])), max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
        size = lambda x: (x[2] - x[0]) * (x[3] - x[1])
        return w * h / (size(a) + size(b) - w * h)

    free, left, out = dict(enumerate(g)), [], []
    order = sorted((k for k in range(len(p)) if p[k][1] >= at), key=lambda k: -p[k][1])
    for same in (True, False):
        todo, left = (order if same else left), []
        for k in todo:
            best = max(((overlap(p[k][2], b), -j) for j, (c, b) in free.items() if (c == p[k][0]) == same), default=(0, 0))
            if best[0] >= least and best[0] > 0:
                out.append(("tp" if same else "cc", k, -best[1]))
                del free[-best[1]]
            else:
                left.append(k)
    return sorted(out + [("fp", k, None) for k in left] + [("fn", None, j) for j in free], key=str)


def test_matching_against_lists(spark):
    rng = random.Random(8)
    g_rows, p_rows, want = [], [], {}
    for n in range(60):
        box = lambda: (x := rng.randint(0, 6) * 2.0, y := rng.randint(0, 4) * 2.0, x + rng.randint(3, 9), y + rng.randint(3, 9))
        g = [(rng.choice([L, R]), tuple(map(float, box()))) for _ in range(rng.randint(0, 5))]
        p = [(rng.choice([L, R]), rng.choice([0.2, 0.5, 0.5, 0.9]), tuple(map(float, box()))) for _ in range(rng.randint(0, 6))]
        g_rows += [(str(n), k, k, c, *b) for k, (c, b) in enumerate(g)]
        p_rows += [("m", str(n), k, c, s, *b) for k, (c, s, b) in enumerate(p)]
        want[str(n)] = plain_match(g, p, 0.3, 0.4)
    short = {"true_positive": "tp", "class_confusion": "cc", "false_positive": "fp", "false_negative": "fn"}
    got = {k: [] for k in want}
    for r in matching.match(spark.createDataFrame(g_rows, GT), spark.createDataFrame(p_rows, PR), ["m"], 0.3, 0.4).collect():
        got[r.image_id].append((short[r.match_type], r.det_pos, r.annotation_id))
    assert {k: sorted(v, key=str) for k, v in got.items()} == want


def test_thresholds(spark):
    far = [(float(30 * k), 50.0, 30.0 * k + 10, 60.0) for k in range(5)]
    g = gt(spark, (L, far[0]), (L, far[1]))
    p = pr(spark, (L, 0.9, far[0]), (L, 0.4, far[1]), (L, 0.4, far[2]), (L, 0.4, far[3]), (L, 0.4, far[4]))
    sweep = evaluation.threshold_sweep(images(spark), g, p, ["m"])
    (best,) = evaluation.select_thresholds(sweep).where("category = 'overall_micro'").collect()
    assert (best.f1_threshold, best.f2_threshold) == (0.9, 0.4)


def test_average_precision(spark):
    other = (50.0, 50.0, 70.0, 70.0)
    g, p = gt(spark, (L, BOX), (R, other)), pr(spark, (L, 0.9, BOX), (R, 0.8, other))
    rows = average_precision.average_precision(images(spark), g, p, ["m"]).collect()
    assert len(rows) == 3 and all(r.ap50 == r.ap75 == r.map_50_95 == pytest.approx(1.0) for r in rows)
    # a surer false one before the true one: precision a half at every recall point
    wrong = pr(spark, (L, 0.9, other), (L, 0.8, BOX))
    by = {r.category: r for r in average_precision.average_precision(images(spark), gt(spark, (L, BOX)), wrong, ["m"]).collect()}
    assert by[L].ap50 == pytest.approx(0.5)


def test_evaluation_rows(spark):
    g, p = gt(spark, (L, BOX), (R, (50.0, 50.0, 70.0, 70.0))), pr(spark, (L, 0.9, BOX))
    rows = {r.category: r for r in evaluation.evaluation_rows(images(spark), g, p, ["m"], 0.5).collect()}
    assert rows["overall_micro"].recall == 0.5 and rows[R].f2 == 0.0 and rows[L].f1 == 1.0
    assert rows["macro_classes"].f1 == 0.5 and rows["macro_classes"].image_count == 1


def test_deltas(spark):
    schema = "split string, model_name string, category string, " + ", ".join(f"{m} double" for m in evaluation.METRICS)
    rows = [("valid", "a", "x", *[0.5] * 6, 0.0), ("valid", "b", "x", *[0.75] * 6, 0.25)]
    (d,) = evaluation.metric_deltas(spark.createDataFrame(rows, schema), "a", "b").collect()
    assert (d.f2_absolute_delta, d.f2_relative_percent, d.map_50_95_relative_percent) == (0.25, 50.0, None)


def test_names(spark):
    rows = spark.createDataFrame([("d/rec_frame000001_0000001500ms_jpg.rf.ab12.jpg",), ("_frame1.jpg",), ("plain.jpg",)], "f string")
    f = F.col("f")
    out = rows.select(names.stable_image_key(f), names.recording_id(f), names.timestamp_seconds(f)).collect()
    assert [tuple(r) for r in out] == [("rec_frame000001_0000001500ms.jpg", "rec", 1.5), ("_frame1.jpg", None, None), ("plain.jpg", None, None)]
    one = spark.range(1)
    assert one.select(names.canonical_category(F.lit(" Left-HAND"))).first()[0] == L
    for name in ("left", "hand left", "HAND_LEFT", " left - hand ", "Left_Hand"):
        assert one.select(names.canonical_category(F.lit(name))).first()[0] == L
        assert one.select(names.canonical_category(F.lit(name.lower().replace("left", "right")))).first()[0] == R
    assert names.check_ordered_classes(["Hand-left", "right"]) == names.check_ordered_classes({1: "RIGHT_hand", 0: "left"}, True) == [L, R]
    for wrong, strict in ((["right", "left"], False), (["left", "right", "x"], False), (["hand left", "right"], True), (["left"], True)):
        with pytest.raises(ValueError, match="left and right"):
            names.check_ordered_classes(wrong, strict)
    with pytest.raises(Exception, match="unknown category"):
        one.select(names.canonical_category(F.lit("foot"))).collect()
    assert one.select(names.frame_file_name(F.lit("..a b/c_"), F.lit(3), F.lit(1.2345))).first()[0] == "a_b_c_frame000003_0000001234ms.jpg"


def test_labels(spark):
    rows = spark.createDataFrame([(-10.0, 10.0, 50.0, 60.0, 100, 50), (868.447, 100.0, 1000.0, 900.0, 1000, 1000), (5.0, 5.0, 5.0, 9.0, 10, 10)], "x1 double, y1 double, x2 double, y2 double, w int, h int")
    lines = [r[0] for r in rows.select(media.yolo_label(F.lit(0), corners(), F.col("w"), F.col("h"))).collect()]
    assert lines[0] == "0 0.250000 0.600000 0.500000 0.800000" and lines[2] is None
    _, cx, _, w, _ = map(float, lines[1].split())
    assert cx + w / 2 <= 1


def test_media(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(media.frame_rate(F.lit("30000/1001"))) == 30000 / 1001 and value(media.frame_rate(F.lit(""))) == 0.0
    assert [value(media.jpeg_qscale(F.lit(q))) for q in (1, 50, 100)] == [31, 17, 2]
    assert value(media.message_seconds(F.lit(0), F.lit(0), F.lit(2_500_000_000))) == 2.5
    assert media.nal_types_of(b"\x00\x00\x00\x01\x67x\x00\x00\x01\x68y\x00\x00\x01\x65z") == {7, 8, 5}
    df = spark.createDataFrame([(bytearray(b"\x00\x00\x01\x65z"),), (None,)], "p binary")
    assert [r[0] for r in df.select(media.nal_types(F.col("p"))).collect()] == [[5], None]


def test_gate(spark):
    """After the gate has opened every packet stays; parameter sets, also a PPS alone, come before a key frame without its own."""
    schema = "r string, n int, has_idr boolean, has_sps boolean, params_only boolean"
    rows = [("a", 0, True, False, False), ("a", 1, False, False, True), ("a", 2, False, True, True), ("a", 3, False, False, False), ("a", 4, True, False, False),
            ("a", 5, False, False, True), ("a", 6, True, True, False), ("b", 0, False, True, True), ("b", 1, True, True, False), ("c", 0, True, False, False)]
    out = dataset.gop_gate(spark.createDataFrame(rows, schema), "r", ["n"]).collect()
    assert sorted((x.r, x.n, x.in_front) for x in out) == [("a", 1, True), ("a", 2, True), ("a", 4, False), ("a", 5, False), ("a", 6, False), ("b", 1, False)]


def test_sampling(spark):
    v = spark.createDataFrame([(3.1, 29.97, 93), (0.0, 30.0, 0)], "duration_seconds double, fps double, frame_count long")
    assert sorted(r.frame_index for r in dataset.sample_points(v, 1.0).collect()) == [0, 29, 59, 89]


def test_revisions(spark):
    i = spark.createDataFrame([("1", "r_frame1_jpg.rf.a.jpg", "train", 9, 9), ("2", "s_frame2_jpg.rf.a.jpg", "train", 9, 9)], IM)
    j = spark.createDataFrame([("1", "r_frame1_jpg.rf.b.jpg", "test", 9, 9), ("3", "t_frame3.jpg", "test", 9, 9)], IM)
    b = lambda *rows: spark.createDataFrame([(k, n, n, c, *x) for n, (k, c, x) in enumerate(rows)], GT)
    old = b(("1", L, BOX), ("1", L, (20.0, 0.0, 30.0, 10.0)), ("1", R, (40.0, 0.0, 50.0, 10.0)), ("1", R, (70.0, 0.0, 80.0, 10.0)))
    new = b(("1", L, (1.0, 0.0, 11.0, 10.0)), ("1", R, (20.0, 0.0, 30.0, 10.0)), ("1", R, (40.0, 0.0, 50.0, 10.0)), ("3", L, BOX), ("1", L, (90.0, 0.0, 95.0, 5.0)))
    out = revision.changes(revision.revision_images(i, old), revision.revision_images(j, new)).collect()
    kinds = sorted((r.change_type, r.old_category, r.new_category) for r in out if r.stable_image_key.startswith("r"))
    assert kinds == [("annotation_added", None, L), ("annotation_removed", R, None), ("bbox_adjusted", L, L), ("relabeled", L, R), ("split_moved", None, None)]
    rest = sorted((r.change_type, r.old_split, r.new_category) for r in out if not r.stable_image_key.startswith("r"))
    assert rest == [("image_added", None, L), ("image_removed", "train", None)]


def test_validation(spark):
    i = spark.createDataFrame([("a", "x_frame1.jpg", "train", 100, 50), ("b", "x_frame2.jpg", "test", 0, 50)], IM)
    assert [r.splits for r in validate.recording_leakage(i).collect()] == [["test", "train"]]
    assert validate.image_size_violations(i).count() == 1
    boxes = spark.createDataFrame([(1, "a", 0.0, 0.0, 100.0, 50.0), (2, "a", -1.0, 0.0, 5.0, 5.0), (3, "a", 0.0, 0.0, 0.0, 5.0), (4, "z", 0.0, 0.0, 1.0, 1.0)], "annotation_id long, image_id string, x double, y double, w double, h double")
    assert {r.annotation_id: r.reason for r in validate.bbox_violations(boxes, i).collect()} == {2: "outside the image", 3: "no extent", 4: "unknown image"}
    with pytest.raises(ValueError):
        validate.require_none(boxes, "boxes")
    with pytest.raises(ValueError):
        validate.check_share("overlap", 1.5)
    three, two = [(3, R), (1, "x"), (2, L)], ["left", "right"]
    assert dataset.class_slots(three, two, 3, [1]) == {0: None, 1: L, 2: R}
    assert dataset.class_slots(three, two, 3) == {0: "left", 1: "right", 2: None}
    for given, n, ignored in ((three, 2, [1]), (three, 4, [1]), ([(1, R), (2, L), (3, "x")], 3, [3]), (three, 0, [])):
        with pytest.raises(ValueError):
            dataset.class_slots(given, two, n, ignored)


def test_classes(spark):
    raw = spark.createDataFrame([(0, "left"), (1, None), (2, "x"), (3, "__background__")], "class_id int, class_name string")
    known = spark.createDataFrame([(2, None), (1, R)], "class_id int, category string")
    assert sorted(r.category for r in dataset.resolve_classes(raw, known).collect()) == ["left", R]
    with pytest.raises(Exception, match="unknown class"):
        dataset.resolve_classes(raw, None).collect()


def test_review(spark):
    g, p = gt(spark, (L, BOX)), pr(spark, (R, 0.9, BOX), (L, 0.7, (50.0, 50.0, 60.0, 60.0)))
    found = matching.match(g, p, ["m", "n"])
    (row,) = review.image_manifest(images(spark), found.where("model_name = 'm'"), ("m",)).collect()
    assert (row.class_confusion_count, row.false_positive_count, row.maximum_false_positive_confidence) == (1, 1, 0.7)
    assert row.source_recording == "rec" and row.timestamp_seconds == 1.5
    by = {r.model_name: r.review_priority for r in review.review_priority(found, "m", "n").collect()}
    assert by == {"m": "left_right_disagreement", "n": "model_error"}
    errors = review.error_manifest(images(spark), found, "m", "n")
    assert sorted(r.error_type for r in errors.collect()) == ["class_confusion", "false_negative", "false_positive"]
    assert review.priorities_by_image(errors).count() == 1


def test_inference(spark):
    # made here, so that it travels to the workers by value
    class Stub:
        def predict_batch(self, images):
            return [len(i) for i in images]

        def normalize(self, result, image):
            return [{"category": L, "confidence": result / 10, "x1": 0.0, "y1": 0.0, "x2": 1.0, "y2": 1.0}]

    rows = spark.createDataFrame([("a", bytearray(b"12")), ("b", bytearray(b"1"))], "file_name string, content binary")
    assert sorted((r.file_name, r.detections[0].confidence) for r in inference.predict(rows, Stub, 1).collect()) == [("a", 0.2), ("b", 0.1)]


STUB = """
def describe(checkpoint):
    return {"class_names": ["left", "right"], "slots": 3, "config": {"kind": "stub"}}


class Stub:
    def __init__(self, confidence):
        self.confidence = confidence

    def predict_batch(self, images):
        assert 0 < len(images) <= 2
        return [len(i) - 1 for i in images]

    def normalize(self, result, image):
        # slots: none, left, right; the third box has no extent inside the image, the fourth is of no wanted class
        made = [(1, 0.5, (-5, 1, 20.00006, 30)), (2, 0.1234567, (90, 40, 200, 300)), (1, 0.9, (100, 0, 120, 9)), (0, 0.9, (0, 0, 9, 9))]
        boxes = [dict(class_id=c, class_name=None, confidence=s, **dict(zip(("x1", "y1", "x2", "y2"), map(float, b)))) for c, s, b in made]
        return [b for b in boxes if b["confidence"] >= self.confidence][: result]


def make(checkpoint, confidence, device):
    return Stub(confidence)
"""


def test_prelabelling(spark, tmp_path):
    import json

    from boxwright import cli
    from boxwright.sources.files import exploded_detections, read_jsonl

    (tmp_path / "stub_detector.py").write_text(STUB)
    spark.sparkContext.addPyFile(str(tmp_path / "stub_detector.py"))
    (tmp_path / "w.bin").write_bytes(b"weights")
    names = [f"rec_frame00000{k}_000000{k}000ms_jpg.rf.x.jpg" for k in range(3)]
    doc = {"images": [{"id": k, "file_name": n, "width": 100, "height": 50} for k, n in enumerate(names)], "annotations": [{"id": 1, "image_id": 1, "category_id": 2, "bbox": [0, 0, 1, 1]}],
           "categories": [{"id": 1, "name": "hands"}, {"id": 2, "name": L}, {"id": 3, "name": R}]}
    for split in ("train", "valid", "test"):
        (tmp_path / split).mkdir()
        (tmp_path / split / "_annotations.coco.json").write_text(json.dumps(doc))
        for k, n in enumerate(names):
            (tmp_path / split / n).write_bytes(b"i" * (1 + 4 * k))
    common = ["--detector", "stub_detector", "--checkpoint", str(tmp_path / "w.bin"), "--model", "m", "--batch", "2"]
    cli.main(["predict-coco", "--dataset", str(tmp_path), "--output", str(tmp_path / "run"), "--split", "valid", *common])
    rows = read_jsonl(spark, str(tmp_path / "run/predictions/m/valid.jsonl"), files.PREDICTION).orderBy("file_name").collect()
    assert [(r.file_name, len(r.detections), r.timestamp_seconds, r.source_recording) for r in rows] == [(n, 2 * (k > 0), float(k), "rec") for k, n in enumerate(names)]
    assert json.loads(rows[0].model_config)["class_slot_mapping"] == {"0": None, "1": L, "2": R} and rows[0].checkpoint_sha256
    one, two = rows[1].detections
    assert (one.category, one.category_id, one.confidence, one.bbox_xyxy, one.raw_class_id) == (L, 0, 0.5, [0.0, 1.0, 20.0001, 30.0], 1)
    assert (two.category, two.category_id, two.confidence, two.bbox_xyxy) == (R, 1, 0.123457, [90.0, 40.0, 100.0, 50.0])
    found = json.loads((tmp_path / "run/latency/m/valid.json").read_text())
    assert (found["image_count"], found["detection_count"]) == (3, 4) and found["per_image_inference_ms"]["max"] >= 0
    # the same detector over frames, the first two of them, with a higher floor
    lines = [{"file_name": f"f{k}.jpg", "output_path": names[k], "source_mcap_stem": "s", "timestamp_seconds": k / 2, "width": 100, "height": 50} for k in range(3)]
    (tmp_path / "frames.jsonl").write_text("\n".join(map(json.dumps, lines)))
    frames = ["predict-frames", "--images", str(tmp_path / "train"), "--output", str(tmp_path / "pre"), *common, "--schema-dataset", str(tmp_path)]
    cli.main([*frames, "--frames", str(tmp_path / "frames.jsonl"), "--limit", "2", "--confidence", "0.25"])
    made = exploded_detections(read_jsonl(spark, str(tmp_path / "pre.jsonl"), files.PREDICTION)).collect()
    assert [(r.file_name, r.split, r.category, r.inference_floor) for r in made] == [("f1.jpg", "frames", L, 0.25)]
    lines[1]["file_name"] = "f0.jpg"
    (tmp_path / "twice.jsonl").write_text("\n".join(map(json.dumps, lines)))
    with pytest.raises(ValueError, match="frames"):
        cli.main([*frames, "--frames", str(tmp_path / "twice.jsonl")])
    (tmp_path / "empty.jsonl").write_text("")
    with pytest.raises(ValueError, match="no frame records"):
        cli.main([*frames, "--frames", str(tmp_path / "empty.jsonl")])
    with pytest.raises(ValueError, match="checkpoint"):
        cli.main([*frames, "--frames", str(tmp_path / "frames.jsonl"), "--checkpoint", str(tmp_path / "none")])


def test_files(spark, tmp_path):
    import json
    import zipfile

    (tmp_path / "valid").mkdir()
    doc = {"images": [{"id": 1, "file_name": "a_frame1.jpg", "width": 9, "height": 9}], "categories": [{"id": 4, "name": "left"}],
           "annotations": [{"id": 7, "image_id": 1, "category_id": 4, "bbox": [1, 2, 3, 4], "area": 12, "iscrowd": 0}]}
    (tmp_path / "valid/_annotations.coco.json").write_text(json.dumps(doc))
    i, a, c = files.read_coco(spark, str(tmp_path), "valid")
    assert i.count() == c.count() == 1 and [tuple(r) for r in a.select("x1", "y1", "x2", "y2", "category").collect()] == [(1, 2, 4, 6, "left")]
    (tmp_path / "p.jsonl").write_text('{"file_name": "a", "detections": [{"category": "left", "confidence": 0.5, "bbox_xyxy": [1, 2, 3, 4.5]}]}\n\n')
    d = files.exploded_detections(files.read_jsonl(spark, f"{tmp_path}/p.jsonl", files.PREDICTION)).collect()
    assert [(r.det_pos, r.y2) for r in d] == [(0, 4.5)]
    assert files.read_jsonl(spark, f"{tmp_path}/none.jsonl", files.FRAME, missing_ok=True).count() == 0
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("valid/x.txt", "x")
    digest = files.import_archive(str(tmp_path / "d.zip"), str(tmp_path / "out"))
    assert files.import_archive(str(tmp_path / "d.zip"), str(tmp_path / "out"), digest) == digest
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../x.txt", "x")
    with pytest.raises(ValueError):
        files.import_archive(str(tmp_path / "bad.zip"), str(tmp_path / "other"))
    assert files.file_digests(spark, str(tmp_path), "*.zip").count() == 2
    assert "| +0.5000 |" in sinks.markdown_table([{"a": 0.5}], ["a"], ["a"]) and "<svg" in sinks.svg_chart({"m": [(0, 1)]}, "t", "x", "y")
    assert "&lt;b" in sinks.html_page("t", [{"f": "<b"}], ["f"])


def record(kind, body):
    return bytes([kind]) + struct.pack("<Q", len(body)) + body


def text(s):
    return struct.pack("<I", len(s)) + s.encode()


def field(number, value):
    """A length-delimited field, or a varint below 128."""
    return bytes([number << 3, value]) if isinstance(value, int) else bytes([number << 3 | 2, len(value)]) + value


def descriptors(numbers):
    """A set of two files: the video message, and the type of its time in a package of its own."""
    one = lambda name, n, kind=b"": field(2, field(1, name.encode()) + field(3, n) + (field(6, kind) if kind else b""))
    time = field(1, b"Time") + one("seconds", numbers["timestamp.seconds"]) + one("nanos", numbers["timestamp.nanos"])
    frame = field(1, b"CompressedVideo") + one("timestamp", numbers["timestamp"], b".clock.Time") + b"".join(one(n, numbers[n]) for n in ("frame_id", "data", "format"))
    return field(1, field(1, b"t") + field(2, b"clock") + field(4, time)) + field(1, field(1, b"v") + field(2, b"foxglove") + field(4, frame))


def recording(tmp_path, codec="zstd", numbers=None):
    import pyarrow as pa
    import zstandard

    of = numbers or video.PUBLIC_NUMBERS

    def message(t, packet):
        stamp = field(of["timestamp.seconds"], t) + field(of["timestamp.nanos"], 0)
        return field(of["timestamp"], stamp) + field(of["frame_id"], b"c") + field(of["data"], packet) + field(of["format"], b"h264")

    packets = [b"\x00\x00\x01\x61p", b"\x00\x00\x01\x67s\x00\x00\x01\x68p", b"\x00\x00\x01\x65i", b"\x00\x00\x01\x61q"]
    known = descriptors(numbers) if numbers else b""
    head = mcap.MAGIC + record(mcap.SCHEMA, struct.pack("<H", 1) + text(video.VIDEO_SCHEMA) + text("protobuf") + struct.pack("<I", len(known)) + known)
    for channel in (5, 6):
        head += record(mcap.CHANNEL, struct.pack("<HH", channel, 1) + text("/cam") + text("protobuf") + struct.pack("<I", 0))
    out, index = head, b""
    for k in range(2):
        inner = b"".join(record(mcap.MESSAGE, struct.pack("<HIQQ", 5, n, n * 40_000_000, 0) + message(n + 1, packets[n])) for n in (2 * k, 2 * k + 1))
        inner += record(mcap.MESSAGE, struct.pack("<HIQQ", 6, 9, 9, 0) + message(9, packets[0]))
        data = zstandard.compress(inner) if codec == "zstd" else pa.Codec("lz4").compress(inner, asbytes=True) if codec == "lz4" else inner
        body = struct.pack("<QQQI", 0, 0, len(inner), 0) + text(codec) + struct.pack("<Q", len(data)) + data
        index += record(mcap.CHUNK_INDEX, struct.pack("<QQQQ", 0, 0, len(out), 0) + struct.pack("<I", 20) + struct.pack("<HQHQ", 5, 0, 6, 0))
        out += record(mcap.CHUNK, body)
    path = tmp_path / f"r{codec}.mcap"
    path.write_bytes(out + index + record(mcap.FOOTER, b"") + mcap.MAGIC)
    return str(path)


def test_recordings(spark, tmp_path):
    spark.dataSource.register(mcap.McapSource)
    other = {"timestamp": 4, "timestamp.seconds": 2, "timestamp.nanos": 1, "frame_id": 3, "data": 2, "format": 1}
    for codec, numbers in (("zstd", None), ("lz4", other), ("", None)):
        # the second channel of the topic isn't read
        read = spark.read.format("mcap").option("topic", "/cam").option("schema_fields", "true")
        messages = read.load(recording(tmp_path, codec, numbers))
        assert {r.channel_id for r in messages.select("channel_id").collect()} == {5}
        rows = video.video_messages(messages)
        assert rows.count() == 4
        gate = video.decodable_packets(rows).orderBy("chunk_no", "message_no").collect()
        assert [(r.message_no + 2 * r.chunk_no, r.in_front) for r in gate] == [(1, True), (2, False), (3, False)]
        (p,) = video.provenance(rows).collect()
        assert (p.frame_id, p.format, p.frame_count, p.time_range_sec, p.average_fps) == ("c", "h264", 2, [3.0, 4.0], 25.0)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    pushed = spark.read.format("mcap").option("pushdown", "true").load(recording(tmp_path)).where("topic = '/cam'")
    assert pushed.count() == 4  # the topic's first channel
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(Exception, match="no topic"):
        spark.read.format("mcap").option("topic", "/none").load(recording(tmp_path)).count()
    with pytest.raises(Exception, match="brotli"):
        spark.read.format("mcap").load(recording(tmp_path, "brotli")).count()


def test_iou_column(spark):
    row = spark.range(1).select(iou(tuple(map(F.lit, (0.0, 0.0, 2.0, 2.0))), tuple(map(F.lit, (1.0, 1.0, 3.0, 3.0)))).alias("i"), iou(tuple(map(F.lit, (0.0, 0.0, 0.0, 0.0))), tuple(map(F.lit, (0.0, 0.0, 0.0, 0.0)))).alias("z")).first()
    assert row.i == 1 / 7 and row.z == 0.0


def test_comparison_of_models(spark, tmp_path):
    import json

    from boxwright.plans import compare

    for k, split in enumerate(compare.SPLITS):
        name = f"rec{k}_frame000001_0000001000ms_jpg.rf.x.jpg"
        doc = {"images": [{"id": 1, "file_name": name, "width": 100, "height": 100}], "categories": [{"id": 1, "name": L}, {"id": 2, "name": R}],
               "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "bbox": [0, 0, 10, 10]}, {"id": 2, "image_id": 1, "category_id": 2, "bbox": [50, 50, 10, 10]}]}
        (tmp_path / split).mkdir()
        (tmp_path / split / "_annotations.coco.json").write_text(json.dumps(doc))
        (tmp_path / split / name).write_bytes(b"image")
        for model, boxes in (("a", [[0, 0, 10, 10]]), ("b", [[0, 0, 10, 10], [50, 50, 60, 60]])):
            found = [{"category": ("left", "right")[n], "confidence": 0.9 - 0.1 * n, "bbox_xyxy": b} for n, b in enumerate(boxes)]
            (tmp_path / "predictions" / model).mkdir(parents=True, exist_ok=True)
            (tmp_path / f"predictions/{model}/{split}.jsonl").write_text(json.dumps({"file_name": name, "model_name": model, "split": split, "width": 100, "height": 100, "detections": found}))
    c = compare.compare(*compare.load(spark, str(tmp_path), str(tmp_path), ("a", "b")), "a", "b")
    assert c.thresholds == {"a": 0.9, "b": 0.8}
    by = {(r.model_name, r.split, r.category): r for r in c.metrics.where("split = 'test'").collect()}
    assert by["b", "test", "overall_micro"].f1 == 1.0 and by["b", "test", "macro_classes"].map_50_95 == 1.0
    assert by["a", "test", "overall_micro"].recall == 0.5 and by["a", "test", R].ap50 == 0.0
    assert {r.error_type for r in c.errors.collect()} == {"false_negative"}
    compare.write_reports(c, str(tmp_path / "out"))
    out = tmp_path / "out"
    assert json.loads((out / "comparison.json").read_text())["thresholds"]["b"] == 0.8
    assert "| test | b | macro_classes | 0.8000 | 1.0000 |" in (out / "metrics.md").read_text()
    assert "| test | overall_micro |" in (out / "deltas.md").read_text() and "+0.5000" in (out / "deltas.md").read_text()
    assert len(list((out / "charts").glob("*.svg"))) == 2 * 3 * 3
    page = (out / "review/test_0001.html").read_text()
    assert "model_only_error" in page and "false_negative" in page and 'src="images/rec2_frame' in page
    # a category without annotations may be there, one with annotations may not
    path = tmp_path / "test" / "_annotations.coco.json"
    doc = json.loads(path.read_text())
    doc["categories"].append({"id": 3, "name": "hands"})
    path.write_text(json.dumps(doc))
    extra = {"id": 7, "image_id": 1, "category_id": 3, "bbox": [0, 0, 5, 5]}
    path.write_text(json.dumps(doc | {"annotations": [*doc["annotations"], extra]}))
    assert files.read_coco(spark, str(tmp_path), "test", (L, R))[1].count() == 2
    with pytest.raises(ValueError, match="unsupported"):
        compare.load(spark, str(tmp_path), str(tmp_path), ("a", "b"))


def test_label_folder(spark, tmp_path):
    """A whole export: images, labels with an empty one, data.yaml and manifest; a second one needs to be told to overwrite."""
    import json

    from boxwright import cli

    (tmp_path / "frames").mkdir()
    base = {"source_mcap_path": "m", "source_mcap_stem": "s", "source_video": "v", "timestamp_seconds": 0.0, "width": 100, "height": 50}
    with open(tmp_path / "f.jsonl", "w") as f, open(tmp_path / "p.jsonl", "w") as p:
        for k in range(3):
            (tmp_path / f"frames/{k}.jpg").write_bytes(b"x" * (k + 1))
            found = [{"category": "right_hand", "confidence": 0.9, "bbox_xyxy": [-10, 10, 50, 60]}, {"category": "left_hand", "confidence": 0.2, "bbox_xyxy": [0, 0, 9, 9]}]
            print(json.dumps(base | {"file_name": f"{k}.jpg"}), file=f)
            print(json.dumps({"file_name": f"{k}.jpg", "width": 100, "height": 50, "model_name": "m", "confidence_threshold": 0.5, "detections": found[: k % 2 + 1] if k else []}), file=p)
    args = ["export-yolo", *(f"--{o}={tmp_path}/{v}" for o, v in (("frames", "f.jsonl"), ("predictions", "p.jsonl"), ("images", "frames"), ("output", "out")))]
    cli.main(args)
    out = tmp_path / "out"
    label = "1 0.250000 0.600000 0.500000 0.800000\n"
    assert [(out / f"labels/train/{k}.txt").read_text() for k in range(3)] == ["", label, label]
    assert (out / "images/train/2.jpg").read_bytes() == b"xxx" and "  1: right_hand" in (out / "data.yaml").read_text()
    rows = [json.loads(x) for x in (out / "manifest.jsonl").read_text().splitlines()]
    assert [(r["file_name"], r["detection_count"], r["label_path"], r["prediction_threshold"]) for r in rows] == [("0.jpg", 0, "labels/train/0.txt", 0.5), ("1.jpg", 1, "labels/train/1.txt", 0.5), ("2.jpg", 1, "labels/train/2.txt", 0.5)]
    with pytest.raises(FileExistsError):
        cli.main(args)
    cli.main([*args, "--overwrite"])
    (tmp_path / "frames/1.jpg").unlink()
    with pytest.raises(ValueError, match="no image"):
        cli.main([*args, "--overwrite"])
