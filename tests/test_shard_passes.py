"""Training shards made in passes: the same set, and no shuffle left behind."""

import os
import time

import pytest
from pyspark.sql import functions as F

from boxframe.operators import shards, store
from boxframe.operators.groups import settings
from boxframe.plans import fixtures

from test_shards import some, written


def in_passes(monkeypatch, passes=4):
    monkeypatch.setattr(shards, "PASSES", passes)
    monkeypatch.setattr(shards, "PASS_ROWS", 1)
    monkeypatch.setattr(shards, "RANGE_BYTES", 900)


def whole(spark, folder):
    rows = spark.read.parquet(f"{folder}/records").collect()
    return sorted((r.split, r.filename, r.part, r.shard, r.place, r.bytes, r.boxes, bytes(r.image)) for r in rows)


def test_passes_and_ranges_give_the_same_set(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "PART_LINES", 100)
    images, labels = some(spark)
    one = shards.write_training_shards(images, labels, f"{tmp_path}/one", 1500).collect()
    in_passes(monkeypatch)
    made, records = [], shards.training_records

    def seen(images, *args, **how):
        made.append([r.filename for r in images.collect()])
        return records(images, *args, **how)

    monkeypatch.setattr(shards, "training_records", seen)
    four = shards.write_training_shards(images, labels, f"{tmp_path}/four", 1500).collect()
    assert sorted(one) == sorted(four)
    assert whole(spark, f"{tmp_path}/one") == whole(spark, f"{tmp_path}/four")
    # Each image is made in one of the passes.
    assert len(made) == 4 and all(made)
    assert sorted(sum(made, [])) == sorted(r.filename for r in images.collect())


def shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (str(f) for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files))
    return {n for n in names if os.path.basename(n).startswith("shuffle_")}


def test_shuffles_and_records_go_with_their_pass(spark, tmp_path, monkeypatch):
    in_passes(monkeypatch, 2)
    images, labels = some(spark)
    images, labels = (t.repartition(3, "split") for t in (images, labels))
    kept, before = spark.conf.get("spark.checkpoint.dir"), shuffled(spark)
    tables = {p for p, _, _ in os.walk(kept)}
    shards.write_training_shards(images, labels, f"{tmp_path}/a", 1500)
    for _ in range(50):
        if not (left := shuffled(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert not [p for p, _, files in os.walk(kept) if p not in tables and files]


def test_settings_are_put_back(spark):
    unset, was = "spark.sql.adaptive.forceOptimizeSkewedJoin", spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(KeyError), settings(spark, {unset: "true", "spark.sql.shuffle.partitions": "3"}):
        assert (spark.conf.get(unset), spark.conf.get("spark.sql.shuffle.partitions")) == ("true", "3")
        raise KeyError
    assert (spark.conf.get(unset), spark.conf.get("spark.sql.shuffle.partitions")) == ("false", was)


@pytest.mark.parametrize("passes", [1, 4])
def test_repeated_images_share_boxes_and_places(spark, tmp_path, monkeypatch, passes):
    in_passes(monkeypatch, passes)
    images, labels = some(spark, n=12)
    twice = images.where("filename in ('p4.png', 'p5.png')")
    plain = {k[:2]: v for k, v in _counts(spark, images, labels, f"{tmp_path}/plain").items()}
    got = _counts(spark, images.unionByName(twice), labels, f"{tmp_path}/twice")
    for (split, name, boxes, records), want in zip(got, map(plain.get, (k[:2] for k in got)), strict=True):
        more = 2 if name in ("p4.png", "p5.png") else 1
        # Each copy has the boxes of both, and stands at the places of both.
        assert (boxes, records) == (want[0] * more, more * more), (split, name)


def _counts(spark, images, labels, folder):
    shards.write_training_shards(images, labels, folder, 700)
    rows = spark.read.parquet(f"{folder}/records").select("split", "filename", F.size("boxes").alias("n")).collect()
    out = {}
    for r in rows:
        out.setdefault((r.split, r.filename), []).append(r.n)
    assert all(len(set(v)) == 1 for v in out.values())
    return {(*k, v[0], len(v)): (v[0], len(v)) for k, v in out.items()}


def test_stems_that_are_not_those_of_the_names(spark, tmp_path, monkeypatch):
    in_passes(monkeypatch)
    images = spark.createDataFrame(
        [("train", "x.png", "a"), ("train", "x.png", "b"), ("val", None, None), ("train", "y.png", "y"), ("test", "y.png", "y")],
        "split string, filename string, stem string",
    ).withColumns({"width": F.lit(640), "height": F.lit(640), "image": F.lit(b"..")})
    lines = [("train", s, k, "1 0.5 0.5 0.1 0.2") for s in "aby" for k in range(1, 4)]
    lines += [("val", None, 1, "1 0.5 0.5 0.1 0.2"), ("train", None, 1, "1 0.5 0.5 0.1 0.2")]
    lines = spark.createDataFrame(lines, "split string, stem string, line_no int, line string")
    labels = store.valid_labels(store.parse_label_lines(lines))
    index = shards.write_training_shards(images, labels, f"{tmp_path}/a", 1 << 20).collect()
    # The two rows of x.png have the boxes of both label files and stand at each other's places.
    assert {(r.split, r.records, r.boxes, r.bytes) for r in index} == {("train", 5, 27, 4 * 247 + 127), ("val", 1, 0, None)}
    assert written(spark, f"{tmp_path}/a")[("train", "y.png", 0)][3] == 3


def test_label_lines_are_filtered_before_they_are_numbered(spark, tmp_path):
    spark.sql(
        """select id div 4 as l_orderkey, id * 7 % 5 as l_partkey, id % 3 as l_suppkey, cast(id % 2 as int) as l_linenumber,
        cast(id % 6 as double) as l_quantity, cast(id as double) as l_extendedprice, 0.5d as l_discount, 0.1d as l_tax,
        if(id % 2 = 0, 'N', 'R') as l_returnflag, 'O' as l_linestatus, timestamp'2020-01-01' as l_shipdate
        from range(400) union all select null, 1, 1, 1, 1d, 1d, 0d, 0d, 'N', 'O', null"""
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    source, text = fixtures.VIEWS["label_lines"]
    plain = spark.sql(text.replace(f"from {source}", "from {t}"), t=fixtures.table(spark, tmp_path, source))
    view = fixtures.view(spark, tmp_path, "label_lines")
    assert view.schema == plain.schema
    key = lambda r: tuple(map(str, r))
    assert sorted(view.collect(), key=key) == sorted(plain.collect(), key=key)
    plan = view.where("split = 'val' and stem > 'img_2'")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Window [")
    assert "Filter" in below and "Filter" not in above and "lpad" not in below
