import datetime
import os

import pytest

from boxframe.operators import versions
from pyspark.sql import functions as F

IMAGES = "split string, filename string, created_at timestamp"
LABELS = "split string, stem string, line_no int, class_id int, cx double, cy double, w double, h double"
T0 = datetime.datetime(2024, 1, 1)
BOX = '[{"class_id":0,"cx":0.5,"cy":0.5,"w":0.1,"h":0.1}]'


def made(spark, root, n=40):
    images = [("train" if i % 4 else "val", f"img {i}.png", T0) for i in range(n)]
    labels = [(s, f[:-4], k, k, 0.5, 0.5, 0.1, 0.1) for s, f, _ in images for k in (1, 2)]
    versions.create(spark.createDataFrame(images, IMAGES), spark.createDataFrame(labels, LABELS), root, 4)


def requested(spark, rows):
    data = [(i, s, BOX, True, f, T0) for i, (s, f) in enumerate(rows)]
    return spark.createDataFrame(data, "req_id long, split string, boxes string, has_image boolean, filename string, ts timestamp")


def names(spark, root, version=None):
    images, labels = versions.read(spark, root, version)
    return (
        sorted((r.split, r.filename) for r in images.collect()),
        sorted((r.split, r.stem, r.line_no) for r in labels.collect()),
    )


def test_commits_make_snapshots_that_stay(spark, tmp_path):
    root = str(tmp_path / "store")
    made(spark, root)
    first = names(spark, root)
    assert len(first[0]) == 40 and len(first[1]) == 80
    version, rejects = versions.save(requested(spark, [("val", "img 1.png"), ("test", "new.jpg"), ("dev", "x.png")]), root)
    assert version == 1 and [r.fault for r in rejects.collect()] == ["split"]
    second = names(spark, root)
    assert sorted(set(second[0]) - set(first[0])) == [("test", "new.png"), ("val", "img 1 - 1.png")]
    assert sorted(set(second[1]) - set(first[1])) == [("test", "new", 1), ("val", "img 1 - 1", 1)]
    gone = spark.createDataFrame([("test", "new.png"), ("val", "img 4.png"), ("train", "absent.png")], "split string, filename string")
    assert versions.delete(gone, root) == 2
    third = names(spark, root)
    assert set(second[0]) - set(third[0]) == {("test", "new.png"), ("val", "img 4.png")}
    assert set(second[1]) - set(third[1]) == {("test", "new", 1), ("val", "img 4", 1), ("val", "img 4", 2)}
    labels = versions.read(spark, root)[1]
    assert versions.edit(root, removed=labels.where("stem = 'img 5' and line_no = 1"), added=labels.where("stem = 'img 6'")) == 3
    fourth = names(spark, root)
    assert set(third[1]) - set(fourth[1]) == {("train", "img 5", 1)}
    assert set(fourth[1]) - set(third[1]) == {("train", "img 6", 3), ("train", "img 6", 4)}
    assert [names(spark, root, v) for v in range(4)] == [first, second, third, fourth]


def test_a_change_of_an_old_snapshot_is_refused(spark, tmp_path):
    root = str(tmp_path / "store")
    made(spark, root)
    keys = spark.createDataFrame([("train", "img 1.png")], "split string, filename string")
    assert versions.delete(keys, root, base=0) == 1
    folders, want = sorted(os.listdir(f"{root}/data")), names(spark, root)
    with pytest.raises(versions.Conflict):
        versions.delete(keys, root, base=0)
    with pytest.raises(versions.Conflict):
        versions.save(requested(spark, [("val", "a.png")]), root, base=0)
    with pytest.raises(versions.Conflict):
        versions.edit(root, cleared=keys.withColumn("stem", F.lit("img 2")), base=0)
    with pytest.raises(versions.Conflict):
        made(spark, root)
    assert versions.versions(spark, root) == [0, 1] and names(spark, root) == want
    assert sorted(os.listdir(f"{root}/data")) == folders


def test_only_touched_parts_are_written(spark, tmp_path):
    root = str(tmp_path / "store")
    made(spark, root)
    versions.delete(spark.createDataFrame([("train", "img 1.png")], "split string, filename string"), root)
    old, new = versions._load(spark, root, 0), versions._load(spark, root, 1)
    for name in versions.TABLES:
        before, after = old[name]["parts"], new[name]["parts"]
        assert sum(before[k] != after.get(k) for k in before) == 1


def test_empty_stores_and_other_splits(spark, tmp_path):
    none = spark.createDataFrame([], IMAGES), spark.createDataFrame([], LABELS)
    root = str(tmp_path / "empty")
    versions.create(*none, root)
    assert names(spark, root) == ([], [])
    assert versions.save(requested(spark, [("val", "a.png")]), root)[0] == 1
    assert names(spark, root) == ([("val", "a.png")], [("val", "a", 1)])
    for split in ("dev", None):
        rows = spark.createDataFrame([(split, "a.png", T0)], IMAGES)
        with pytest.raises(Exception, match="no such split"):
            versions.create(rows, none[1], str(tmp_path / f"odd-{split}"))


def test_a_part_of_many_rows_is_written_by_several_tasks(spark, tmp_path):
    from boxframe.operators import versions as module

    rows = spark.range(20_000).repartition(8).selectExpr("'train' split", "concat('s', id) stem", "md5(string(id)) v")
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "64k")
    try:
        parts, _ = module._write(rows, str(tmp_path), "labels", 1)
    finally:
        spark.conf.unset(key)
    (folder,) = parts["train/0"]
    assert len(list((tmp_path / folder).glob("part-*"))) > 1
    assert spark.read.parquet(str(tmp_path / folder)).count() == 20_000
