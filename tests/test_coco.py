import json
import random

import pytest
from conftest import rows

from boxframe.sources import coco


def document(n, seed):
    rng = random.Random(seed)
    texts = ['plain', 'a "quoted" }', "back\\slash\\", '}{][', '"}', "new\nline", "ünï }"]
    images = [
        {"id": i, "file_name": f"{rng.choice(texts)} {i}.png", "width": 100, "height": 50} for i in range(n)
    ]
    annotations = []
    for i in range(n):
        a = {"id": i, "image_id": rng.randrange(n), "category_id": 1, "bbox": [1.0, 2.0, 3.0, 4.0]}
        if i % 3 == 0:
            a["segmentation"] = {"size": [3, 4], "counts": rng.choice(texts), "deep": {"x": [{}, {"y": "}"}]}}
        annotations.append(a)
    return {
        "info": {"year": 1, "more": {"annotations": [{"id": 99}]}, "text": rng.choice(texts)},
        "licenses": [],
        "numbers": [[1, 2], [3]],
        "images": images,
        "categories": [{"id": 1, "name": rng.choice(texts)}],
        "annotations": annotations,
        "end": "}",
    }


def texts(found):
    return rows(found.drop("doc"))


@pytest.mark.parametrize("indent", [None, 2])
def test_any_number_of_ranges_gives_the_document(spark, tmp_path, indent):
    made = document(400, 3)
    path = f"{tmp_path}/a.json"
    text = json.dumps(made, indent=indent, ensure_ascii=False)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text + ("\n" if indent else ""))
    want_images = sorted([(i["id"], i["file_name"], 100, 50) for i in made["images"]], key=repr)
    want = sorted([(a["id"], a["image_id"], 1, [1.0, 2.0, 3.0, 4.0]) for a in made["annotations"]], key=repr)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    size = len(text.encode())
    try:
        for ranges in (1, 64):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // ranges + 2))
            blocks = coco._pieces(spark, path).select("block").distinct().count()
            assert blocks == 1 if ranges == 1 else blocks > 30
            got = coco.read_documents(spark, path)
            assert texts(got.images) == want_images
            assert texts(got.annotations) == want
            assert got.rejects.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_rejects(spark, tmp_path):
    good = {"id": 1, "image_id": 7, "category_id": 3, "bbox": [10, 5, 20, 10], "more": {"a": {}}}
    image = {"id": 7, "file_name": "x y.png", "width": 100, "height": 50}
    whole = json.dumps({"images": [image], "annotations": [good, {"image_id": 7}, {"id": "q", "image_id": 7}]})
    files = {
        "whole": whole,
        "other": json.dumps({"annotations": [good], "images": [dict(image, width=200)]}),
        "cut": json.dumps({"images": [image], "annotations": [good, dict(good, id=2)]})[:-8],
        "quote": json.dumps({"images": [image]})[:-1] + ', "annotations": [{"id": 3, "image_id": 7, "x": "]}',
        "long": json.dumps({"images": [image], "annotations": [dict(good, more={"t": {"t": "x" * 900}})]}),
        "empty": "",
        "blank": "{}",
        "lists": '{"images": [], "annotations": []}',
    }
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    boxes, rejects = coco.read_labels(spark, str(tmp_path), offset=1, most=500)
    got = {(r.doc.rsplit("/", 1)[1], r.ann_id): (r.class_id, r.cx, r.w) for r in boxes.collect()}
    assert got == {
        ("whole.json", 1): (2, 0.2, 0.2),
        ("other.json", 1): (2, 0.1, 0.1),
        ("cut.json", 1): (2, 0.2, 0.2),
    }
    why = sorted((r.doc.rsplit("/", 1)[1], r.section, r.reason) for r in rejects.fillna("").collect())
    assert why == [
        ("cut.json", "", "unbalanced"),
        ("long.json", "annotations", "long"),
        ("quote.json", "", "unbalanced"),
        ("whole.json", "annotations", "id"),
        ("whole.json", "annotations", "json"),
    ]


def test_pieces_stay_where_they_are_read(spark, tmp_path):
    """An object over many blocks is whole, one that is too long is rejected, and the
    texts are found without a shuffle of the pieces."""
    deep = {"id": 5, "image_id": 1, "category_id": 1, "bbox": [1.0, 2.0, 3.0, 4.0], "x": [{"y": {"}": k}} for k in range(300)]}
    rest = [dict(deep, id=k, x=[]) for k in range(6, 60)]
    long = dict(deep, id=4, x=deep["x"] * 3)
    made = {"images": [{"id": 1, "file_name": "a.png", "width": 100, "height": 50}], "annotations": [deep, *rest, long, deep]}
    (tmp_path / "a.json").write_text(json.dumps(made))
    (tmp_path / "b.json").write_text(json.dumps(dict(reversed(made.items()))))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        pieces = coco._measured(coco._pieces(spark, str(tmp_path)))
        assert pieces.select("doc", "block").distinct().count() > 12
        blocks = coco._blocks(pieces.drop("piece").mapInArrow(coco._totals, coco.TOTALS))
        found = coco._found(pieces.drop("size"), coco.durable(blocks), 7000)
        assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
        boxes, rejects = coco.read_labels(spark, str(tmp_path), most=7000)
        got = sorted((r.doc[-6], r.ann_id) for r in boxes.collect())
        want = [5, 5, *range(6, 60)]
        assert got == [(name, k) for name in "ab" for k in want]
        assert sorted((r.doc[-6], r.section, r.reason) for r in rejects.collect()) == [
            ("a", "annotations", "long"),
            ("b", "annotations", "long"),
        ]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_commas_between_equal_objects(spark, tmp_path):
    images = spark.createDataFrame([(d, k) for d in (1, 2) for k in (2, 1, 1)], "doc long, id long")
    coco.write_documents(images, images.withColumn("image_id", coco.F.col("id")), f"{tmp_path}/d")
    for d in (1, 2):
        (file,) = (tmp_path / "d" / f"doc={d}").glob("part-*")
        made = json.loads(file.read_text())
        assert made["images"] == [{"id": 1}, {"id": 1}, {"id": 2}]
        assert made["annotations"] == [{"id": k, "image_id": k} for k in (1, 1, 2)]
