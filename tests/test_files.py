import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxframe.operators import detect as dt
from boxframe.operators import raster, runs, store
from boxframe.sources import files


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


# A 2 by 2 picture in the simplest of the formats the image source reads.
BMP = (
    b"BM" + (54 + 16).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    + (40).to_bytes(4, "little") + (2).to_bytes(4, "little") * 2 + (1).to_bytes(2, "little")
    + (24).to_bytes(2, "little") + bytes(24) + bytes([1, 2, 3, 4, 5, 6, 0, 0, 7, 8, 9, 10, 11, 12, 0, 0])
)


def test_label_files_round_trip(spark, tmp_path):
    root = str(tmp_path)
    put(f"{root}/labels/train/a - 1.txt", b"0 0.5 0.5 0.1 0.1\r\n1 0.25 0.1234565 0.1 0.1\n\nbad line\n")
    put(f"{root}/labels/val/empty.txt", b"")
    put(f"{root}/images/train/a - 1.png", BMP)
    put(f"{root}/images/val/empty.png", BMP)
    good, bad = files.read_labels(spark, root)
    got = sorted(map(tuple, good.collect()))
    assert got == [("train", "a - 1", 1, 0, 0.5, 0.5, 0.1, 0.1), ("train", "a - 1", 2, 1, 0.25, 0.1234565, 0.1, 0.1)]
    assert [r.fault for r in bad.collect()] == ["arity"]
    images = files.list_images(spark, root)
    entries = store.list_entries(images, files.read_label_lines(spark, root))
    assert sorted((e.filename, e.num_boxes) for e in entries.collect()) == [("a - 1.png", 3), ("empty.png", 0)]
    out = f"{root}/out"
    files.write_labels(good, out, images)
    odd = good.withColumn("stem", F.when(F.col("line_no") == 2, "../x").otherwise(F.col("stem")))
    left = files.write_labels(odd, f"file://{root}/odd")
    assert [tuple(r) for r in left.collect()] == [("train", "../x", 2)]
    assert sorted(os.listdir(f"{root}/odd/labels/train")) == ["a - 1.txt"]
    files.write_labels(good, out, images)
    with open(f"{out}/labels/train/a - 1.txt") as f:
        assert f.read() == "0 0.500000 0.500000 0.100000 0.100000\n1 0.250000 0.123456 0.100000 0.100000\n"
    assert os.path.getsize(f"{out}/labels/val/empty.txt") == 0
    assert sorted(os.listdir(f"{out}/labels/train")) == ["a - 1.txt"]


def test_images_and_audit(spark, tmp_path):
    put(f"{tmp_path}/images/train/a - 1.bmp", BMP)
    put(f"{tmp_path}/images/train/broken.png", b"\x89PNG\r\n\x1a\n....")
    images = files.read_images(spark, f"{tmp_path}/images")
    totals = {r.status: r.files for r in raster.audit_totals(raster.audit_images(images)).collect()}
    assert totals == {"ok": 1, "undecodable": 1}
    good, other = dt.usable_frames(images)
    row = good.first()
    assert row.image_id.endswith("a - 1.bmp") and bytes(row.data[:3]) == bytes([7, 8, 9])
    assert other.count() == 1
    kinds = files.read_bytes(spark, f"{tmp_path}/images").select(raster.magic_kind("content")).collect()
    assert sorted(r[0] for r in kinds) == ["bmp", "png"]


def test_manifest_and_coco(spark, tmp_path):
    path = f"{tmp_path}/m/data.yaml"
    assert [r.class_name for r in files.read_classes(spark, path).collect()] == ["ecoli"]
    assert files.write_manifest(path, str(tmp_path), ["a", "b"])
    assert not files.write_manifest(path, str(tmp_path), ["c"])
    assert [r.class_name for r in files.read_classes(spark, path).collect()] == ["a", "b"]
    with open(path, "a") as f:
        f.write("extra: 5\n")
    files.extend_manifest(path, ["a", "b", "c"])
    assert [r.class_name for r in files.read_classes(spark, path).collect()] == ["a", "b", "c"]
    with open(path) as f:
        assert "extra: 5" in f.read()
    doc = {
        "images": [{"id": 7, "file_name": "x y.png", "width": 100, "height": 50}],
        "annotations": [{"id": 1, "image_id": 7, "category_id": 3, "bbox": [10, 5, 20, 10]}],
    }
    put(f"{tmp_path}/coco.json", json.dumps(doc).encode())
    row = files.read_coco(spark, f"{tmp_path}/coco.json", offset=1).first()
    assert tuple(row) == ("x y.png", "x y", 1, 2, 0.2, 0.2, 0.2, 0.2)


def test_scorer_and_nested(spark, tmp_path):
    data = np.zeros((4, 4, 3), dtype=np.uint8)
    data[1, 2] = 255
    rows = [("a", 4, 4, 3, data.tobytes(), 1.5), ("b", 4, 4, 3, bytes(48), 2.5)]
    images = spark.createDataFrame(
        rows, "image_id string, height int, width int, nChannels int, data binary, inference_ms double"
    )

    def scorer():
        def score(frame):
            y, x = np.nonzero(frame[:, :, 0])
            return [(a, b, a + 1, b + 1, 0.9, 4) for a, b in zip(x, y)]

        return score

    broken = spark.createDataFrame([("c", -1, -1, -1, None, None)], images.schema)
    dets, unusable = dt.detect(images.unionByName(broken), scorer, 0.5)
    assert [r.image_id for r in unusable.collect()] == ["c"]
    assert [tuple(r) for r in dets.collect()] == [("a", 0, 2.0, 1.0, 3.0, 2.0, 0.9, 4)]
    shown = dets.withColumn("out_pos", F.col("det_idx")).withColumn("class_name", F.lit("n"))
    nested = {r.image_id: r for r in dt.nest_predictions(shown, images).collect()}
    assert len(nested["a"].detections) == 1 and nested["b"].detections == []
    assert nested["a"].image_size.width == 4
    dt.write_predictions(shown, images, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    many = shown.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("out_pos"), *shown.columns[2:-2], "class_name")
    parts = dt.nest_predictions(many, images, part_rows=4).collect()
    assert sorted((r.image_id, r.part, len(r.detections)) for r in parts) == [("a", 0, 4), ("a", 1, 3), ("b", 0, 0)]


def test_run_states_and_tail(spark):
    events = [
        ("k", 0, "start", None), ("k", 1, "kill", None), ("k", 2, "exit", 0),
        ("c", 0, "kill", None), ("c", 1, "start", None), ("c", 2, "exit", 0), ("c", 3, "kill", None), ("c", 4, "exit", 9),
        ("f", 0, "start", None), ("f", 1, "exit", 3),
        ("r", 0, "start", None), ("r", 1, "log", None),
        ("i", 0, "kill", None), ("x", 0, "start", None), ("x", 1, "kill", None),
    ]
    df = spark.createDataFrame(events, "run string, seq int, kind string, return_code int")
    got = {r.run: r.state for r in runs.run_states(df).collect()}
    assert got == {"k": "killed", "c": "completed", "f": "failed", "r": "running", "i": "idle", "x": "killed"}
    lines = spark.createDataFrame([("k", i, f"\x1b[1;32ml{i}\x1b[0m\r\n") for i in range(9)], "run string, seq int, line string")
    status = {r.run: r.log_lines for r in runs.run_status(df, lines, 2).collect()}
    assert status["k"] == ["l7", "l8"] and status["f"] == []
    spans = spark.createDataFrame([("a", 0, 50), ("b", 10, 20), ("c", 60, None), ("d", 200, 210)], "run string, started long, finished long")
    assert sorted(r.run for r in runs.overlapping_runs(spans, 16).collect()) == ["b", "d"]


BOX = "split string, stem string, line_no int, class_id int, cx double, cy double, w double, h double"


def test_a_label_job_that_fails_leaves_nothing(spark, tmp_path):
    root = str(tmp_path)
    rows = [("train", f"img {i}", 1, i, 0.5, 0.5, 0.1, 0.1) for i in range(60)]
    good = spark.createDataFrame(rows, BOX)
    put(f"{root}/labels/train/img 3.txt", b"old\n")
    long = F.when(F.col("class_id") == 41, F.repeat(F.lit("x"), 300)).otherwise(F.col("stem"))
    with pytest.raises(Exception, match="too long"):
        files.write_labels(good.withColumn("stem", long), root)
    assert os.listdir(f"{root}/labels/train") == ["img 3.txt"]
    assert os.listdir(f"{root}/.staged") == []
    files.write_labels(good, root)
    assert len(os.listdir(f"{root}/labels/train")) == 60 and os.listdir(f"{root}/.staged") == []
    with open(f"{root}/labels/train/img 3.txt") as f:
        assert f.read() == "3 0.500000 0.500000 0.100000 0.100000\n"


def test_a_label_job_that_dies_is_finished_later(spark, tmp_path):
    root = str(tmp_path)
    rows = [{"split": "val", "stem": s, "line": line} for s, line in (("a", "1"), ("a", "2"), ("b", None))]
    dead, undecided = files._LabelWriter(root), files._LabelWriter(root)
    lost = dead.write(iter([{"split": "val", "stem": "c", "line": "of a lost attempt"}]))
    staged = [dead.write(iter(rows)), None, dead.write(iter([]))]
    undecided.write(iter([{"split": "val", "stem": "d", "line": "x"}]))
    assert lost.folder != staged[0].folder and not os.path.exists(f"{root}/labels")
    dead.note(staged)
    # It dies after its first file.
    os.makedirs(f"{root}/labels/val")
    os.rename(f"{root}/.staged/{dead.job}/{staged[0].folder}/val/a.txt", f"{root}/labels/val/a.txt")
    assert files.finish_writes(root) == 1
    assert sorted(os.listdir(f"{root}/labels/val")) == ["a.txt", "b.txt"]
    assert os.path.getsize(f"{root}/labels/val/b.txt") == 0
    assert os.listdir(f"{root}/.staged") == [undecided.job]
    assert files.finish_writes(root, abandoned=True) == 0 and os.listdir(f"{root}/.staged") == []
