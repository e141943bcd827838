"""Files under their exact names, byte for byte as Python writes them."""

import csv
import io
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from boxwright.sources import sinks


def by_python(names, rows):
    out = io.StringIO(newline="")
    writer = csv.DictWriter(out, fieldnames=names)
    writer.writeheader()
    writer.writerows(rows)
    return out.getvalue().encode()


@pytest.mark.parametrize("partitions", [1, 5])
def test_csv(spark, tmp_path, partitions):
    rng = random.Random(partitions)
    odd = [0.0, -0.5, 1e-4, 0.00012, 9.9e-4, 1e-5, 1.5e-5, -3e-7, 2e-10, 0.719641, 123456.75, 1e7, 12345678.5, 9.5e15, 1e16, 2.5e20, 1.0, None]
    texts = ["plain", 'a "quote"', "comma, here", "two\nlines", "", None, "ü"]
    rows = [{"k": k, "v": odd[k] if k < len(odd) else round(rng.random(), 6), "t": rng.choice(texts), "b": rng.choice([True, False, None]), "box": [1.0, round(rng.random(), 4)]} for k in range(60)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "k int, v double, t string, b boolean, box array<double>").repartition(partitions)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        sinks.write_csv_file([df], str(tmp_path / "a.csv"), "k")
        sinks.write_jsonl_file(df, str(tmp_path / "a.jsonl"), "k")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert (tmp_path / "a.csv").read_bytes() == by_python(["k", "v", "t", "b", "box"], rows)
    assert [json.loads(x) for x in (tmp_path / "a.jsonl").read_text().splitlines()] == rows
    assert list(json.loads((tmp_path / "a.jsonl").read_text().splitlines()[0])) == ["b", "box", "k", "t", "v"]
    # a second frame adds a column; the file is replaced; without rows it is empty
    more = spark.createDataFrame([(100, 2.5)], "k int, w double")
    sinks.write_csv_file([df.select("k").where("k = 1"), more], str(tmp_path / "a.csv"), "k")
    assert (tmp_path / "a.csv").read_bytes() == b"k,w\r\n1,\r\n100,2.5\r\n"
    sinks.write_csv_file([more.where("k < 0")], str(tmp_path / "a.csv"), "k")
    assert (tmp_path / "a.csv").read_bytes() == b""
    sinks.write_csv_file([more.select(F.lit(None).cast("string").alias("x"))], str(tmp_path / "b.csv"))
    assert (tmp_path / "b.csv").read_bytes() == b'x\r\n""\r\n'
    # nothing is left beside the files, and a failing job leaves the old one
    with pytest.raises(Exception, match="stop"):
        sinks.write_csv_file([df.select(F.raise_error(F.lit("stop")).cast("int").alias("k"))], str(tmp_path / "b.csv"), "k")
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["a.csv", "a.jsonl", "b.csv"]
    assert (tmp_path / "b.csv").read_bytes() == b'x\r\n""\r\n'


def test_label_folder_attempts(tmp_path):
    """Attempts that die, run twice or come late leave nothing; the manifest is in order; a new export replaces the old labels."""
    import pyarrow as pa

    from boxwright.sources.label_folder import LabelFolderWriter

    (tmp_path / "frames").mkdir()
    names = [f"{k}.jpg" for k in range(6)]
    for k, n in enumerate(names):
        (tmp_path / "frames" / n).write_bytes(b"x" * k)
    out = tmp_path / "out"

    def batches(of, dies=False):
        for n in of:
            yield pa.RecordBatch.from_pylist([{"file_name": n, "label": f"0 {n}\n", "detections": 1, "t": 0.5}])
        if dies:
            raise OSError("killed")

    def writer(token):
        return LabelFolderWriter(str(out), str(tmp_path / "frames"), "path: .\n", token)

    w = writer("a")
    with pytest.raises(OSError, match="killed"):
        w.write(batches(names[:2], dies=True))
    late = w.write(batches(names[3:]))
    w.write(batches(names[:3]))  # a speculative twin, whose message Spark drops
    w.commit([late, w.write(batches(names[:3])), w.write(batches([]))])
    assert sorted(str(p.relative_to(out)) for p in out.rglob("*") if p.is_file()) == sorted(
        ["data.yaml", "manifest.jsonl", *(f"images/train/{n}" for n in names), *(f"labels/train/{n[0]}.txt" for n in names)]
    )
    first = {"detection_count": 1, "file_name": "0.jpg", "image_path": "images/train/0.jpg", "label_path": "labels/train/0.txt", "t": 0.5}
    lines = (out / "manifest.jsonl").read_text().splitlines()
    assert lines[0] == json.dumps(first, sort_keys=True) and [json.loads(x)["file_name"] for x in lines] == names
    assert (out / "images/train/5.jpg").samefile(tmp_path / "frames/5.jpg")
    # an aborted export leaves the old one as it was; so does one without frames, or with a name that leads elsewhere
    before = sorted(out.rglob("*"))
    b = writer("b")
    b.write(batches(names[:1]))
    b.abort([None])
    with pytest.raises(ValueError, match="no frames"):
        writer("c").commit([writer("c").write(batches([]))])
    for bad in ("../x.jpg", "a/b.jpg", "..", ""):
        with pytest.raises(ValueError, match="name of a file"):
            writer("d").write(batches([bad]))
    writer("c").abort([])
    writer("d").abort([])
    assert sorted(out.rglob("*")) == before
    # parts of the new export replace the old ones; other files stay
    (out / "notes.txt").write_text("mine")
    w = writer("e")
    w.commit([w.write(batches(names[:1]))])
    assert [p.name for p in (out / "labels/train").iterdir()] == ["0.txt"] and (out / "notes.txt").read_text() == "mine"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["frames", "out"]


def test_label_folder_of_bare_records(spark, tmp_path):
    """Frames without a size and detections without a confidence, as the smallest records have them."""
    from boxwright import cli

    (tmp_path / "frames").mkdir()
    frames, predictions = [], []
    for k, n in enumerate(("one", "two")):
        (tmp_path / f"frames/{n}.jpg").write_bytes(n.encode())
        frames.append({"file_name": f"{n}.jpg", "source_mcap_path": f"/{n}.mcap", "source_mcap_stem": n, "source_video": f"{n}.mp4", "timestamp_seconds": k + 1.0})
        found = [] if k else [{"category": "right_hand", "bbox_xyxy": [25, 10, 75, 40]}]
        predictions.append({"file_name": f"{n}.jpg", "width": 100, "height": 50, "detections": found})
    for name, rows in (("f.jsonl", frames), ("p.jsonl", predictions)):
        (tmp_path / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
    args = ["export-yolo", *(f"--{o}={tmp_path}/{v}" for o, v in (("frames", "f.jsonl"), ("predictions", "p.jsonl"), ("images", "frames"), ("output", "out")))]
    cli.main(args)
    out = tmp_path / "out"
    assert (out / "labels/train/one.txt").read_text() == "1 0.500000 0.500000 0.500000 0.600000\n" and (out / "labels/train/two.txt").read_text() == ""
    made = {"image_path": "images/train/two.jpg", "label_path": "labels/train/two.txt", "detection_count": 0}
    about = {"prediction_model": None, "prediction_threshold": None, "checkpoint_sha256": None}
    assert (out / "manifest.jsonl").read_text().splitlines()[1] == json.dumps(frames[1] | made | about, sort_keys=True)
    # an image that vanishes, two images with one label file, and images inside of the export
    lines = spark.createDataFrame([("one.jpg", None, ""), ("gone.jpg", None, "")], "file_name string, det_pos int, line string")
    with pytest.raises(Exception, match="is missing"):
        sinks.export_yolo(lines, lines.select("file_name"), str(tmp_path / "frames"), str(tmp_path / "new"), ["a"])
    twins = spark.createDataFrame([("one.jpg", None, ""), ("one.png", None, "")], lines.schema)
    with pytest.raises(ValueError, match="one label file"):
        sinks.export_yolo(twins, twins.select("file_name"), None, str(tmp_path / "new"), ["a"])
    with pytest.raises(ValueError, match="inside"):
        sinks.export_yolo(lines, lines.select("file_name"), str(out / "images/train"), str(out), ["a"], overwrite=True)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["f.jsonl", "frames", "out", "p.jsonl"]


def test_coco_file(spark, tmp_path):
    """A written document is JSON in the order of ids, also without annotations; ids that repeat are an error."""
    images = spark.createDataFrame([(k, f"{k}ü.jpg", 8, 6) for k in (3, 1, 2)], "id bigint, file_name string, width int, height int")
    boxes = spark.createDataFrame([(k, 1 + k % 3, 1, [0.0, 1.0, 2.0, 3.5], 7.0, 0) for k in range(9)], "id bigint, image_id bigint, category_id int, bbox array<double>, area double, iscrowd int").repartition(3)
    path = str(tmp_path / "a.json")
    sinks.write_coco_file(images, boxes, [(1, "left_hand")], path)
    got = json.loads((tmp_path / "a.json").read_text())
    assert got["categories"] == [{"id": 1, "name": "left_hand"}] and [i["id"] for i in got["images"]] == [1, 2, 3]
    assert got["annotations"] == [{"id": k, "image_id": 1 + k % 3, "category_id": 1, "bbox": [0.0, 1.0, 2.0, 3.5], "area": 7.0, "iscrowd": 0} for k in range(9)]
    sinks.write_coco_file(images, boxes.where("id < 0"), [], path)
    assert json.loads((tmp_path / "a.json").read_text())["annotations"] == []
    with pytest.raises(ValueError, match="repeated ids"):
        sinks.write_coco_file(images.unionByName(images), boxes, [], path)


def test_objects_of_a_document_are_not_taken_to_be_few(spark, tmp_path):
    """A join with the objects of a COCO document has no broadcast of all of these; their size was taken for that of the document's ranges."""
    from boxwright.sources import files

    images = spark.range(40).selectExpr("id", "concat(id, '.jpg') as file_name", "64 as width", "48 as height")
    boxes = spark.range(90).selectExpr("id", "id % 40 as image_id", "1L as category_id", "array(1D, 2D, 3D, 4D) as bbox", "12D as area", "0 as iscrowd")
    sinks.write_coco_file(images, boxes, [(1, "left_hand")], str(tmp_path / "train/_annotations.coco.json"))
    found, annotations, _ = files.read_coco(spark, str(tmp_path), "train")
    both = annotations.join(found.select("image_id", "file_name"), "image_id")
    assert both._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin") == 1  # of the categories
    assert sorted((r.annotation_id, r.file_name) for r in both.collect()) == [(k, f"{k % 40}.jpg") for k in range(90)]


def test_parts_of_a_file_go_when_they_are_in_it(spark, tmp_path, monkeypatch):
    """The parts are compressed and don't lie beside the whole file; a file that can't be made leaves nothing behind."""
    kept = tmp_path / "shared"
    kept.mkdir()
    monkeypatch.setattr(sinks, "shared_folder", lambda s: f"file://{kept}")
    sizes = []
    lines = spark.range(0, 40_000, 1, 4).select(F.concat(F.lit("a line like any other, of number "), "id").alias("value"))
    append = sinks._append

    def appended(*a):
        sizes.append(sum(f.stat().st_size for f in kept.rglob("part-*")))
        return append(*a)

    monkeypatch.setattr(sinks, "_append", appended)
    sinks.write_lines(lines, str(tmp_path / "a.txt"), "\n", "head")
    text = (tmp_path / "a.txt").read_text()
    assert text.splitlines() == ["head", *(f"a line like any other, of number {k}" for k in range(40_000))]
    assert not list(kept.iterdir())
    assert sizes == sorted(sizes, reverse=True) and sizes[0] < len(text) / 2 and sizes[-1] < sizes[0] / 2
    before = sorted(tmp_path.rglob("*"))
    with pytest.raises(Exception, match="(?i)is a directory|not a directory|mkdirs|exist|parent"):
        sinks.write_lines(lines, str(tmp_path / "a.txt/b.txt"), "\n")
    assert [p for p in sorted(tmp_path.rglob("*")) if not p.name.endswith(".crc")] == [p for p in before if not p.name.endswith(".crc")]


def test_label_folders_one_after_another(spark, monkeypatch):
    """A query over label folders has a bounded number of label files on disk; it had one for each image at once."""
    from boxwright.plans import queries
    from boxwright.sources import files

    made, kept = [], []
    export, read = sinks.export_yolo, files.read_label_folder

    def exported(*a):
        made.append(export(*a))
        kept.append(a[3])
        assert [k for k in kept if Path(k.removeprefix("file:")).exists()] == [a[3]]

    def broken(s, folder):
        found = read(s, folder)
        if len(made) == 2:
            next(Path(folder.removeprefix("file:")).glob("labels/train/*.txt")).unlink()
        return found

    monkeypatch.setattr(queries, "_FOLDER", 400)
    monkeypatch.setattr(sinks, "export_yolo", exported)
    want = sorted(map(tuple, queries.label_files(spark, "/root/testdata/sf0.001").collect()))
    assert sorted(map(tuple, queries.label_folder(spark, "/root/testdata/sf0.001").collect())) == want
    assert len(made) == 4 and sum(m["images"] for m in made) == len(want) == 1500 and max(m["images"] for m in made) < 450
    # a label file that the manifest names and that isn't there was taken for an empty one
    made.clear()
    monkeypatch.setattr(files, "read_label_folder", broken)
    with pytest.raises(Exception, match="(?i)no such file|cannot open"):
        queries.label_folder(spark, "/root/testdata/sf0.001")


def kept_by(spark, run):
    """What a query gives, and the bytes that it leaves in the shared folder."""
    from boxwright.sources.scratch import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:").replace("//", "/"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = size()
    rows = run().collect()
    return rows, size() - before


def test_records_read_back_are_kept_as_their_sums(spark):
    """Not as a row for each detection."""
    from boxwright.plans import queries

    found = queries.detection_records(spark, "/root/testdata/sf0.001")
    want = found.groupBy("file_name", "model_name").agg(F.count(F.lit(1)), F.max("confidence"), F.min("x1")).collect()
    rows, size = kept_by(spark, lambda: queries.prediction_file(spark, "/root/testdata/sf0.001"))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, want)) and size < 20 * found.count()


def test_ranked_detections_are_kept_compressed(spark):
    """Once, those that take a box, with their counts; before, rows of all detections twice, and of 20 numbers for each that takes a box."""
    from boxwright.plans import queries

    n = queries.confidence_filter(spark, "/root/testdata/sf0.001").count()
    rows, size = kept_by(spark, lambda: queries.coco_ap(spark, "/root/testdata/sf0.001"))
    assert len(rows) == 18 and size < 60 * n
