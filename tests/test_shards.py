"""Training shards: whole, repeatable, bounded by bytes."""

import pytest

from boxframe.operators import shards, store

IMAGES = "split string, filename string, width int, height int, image binary"
LINES = "split string, stem string, line_no int, line string"


def some(spark, n=90, parts=5):
    names = [("val" if i % 3 == 0 else "train", f"p{i}.png") for i in range(n)]
    lines = [
        (s, f"p{i}", k, f"{k % 3} 0.5 0.5 0.{k % 8 + 1} 0.1")
        for i, (s, _) in enumerate(names)
        for k in range(1, i % 6)
    ]
    names += [("train", "hot.png")]
    images = [(s, f, 640, 480, bytes(i % 200)) for i, (s, f) in enumerate(names)]
    lines += [("train", "hot", k, "1 0.4 0.6 0.1 0.2") for k in range(1, 301)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(parts)
    images, lines = frame(images, IMAGES), frame(lines, LINES)
    return images, store.valid_labels(store.parse_label_lines(lines))


def written(spark, folder):
    rows = spark.read.parquet(f"{folder}/records").collect()
    return {(r.split, r.filename, r.part): (r.shard, r.place, r.bytes, len(r.boxes)) for r in rows}


def test_shards_hold_all_records_within_their_bytes(spark, tmp_path):
    images, labels = some(spark)
    index = shards.write_training_shards(images, labels, f"{tmp_path}/a", 1500).collect()
    rows = written(spark, f"{tmp_path}/a")
    assert len(rows) == 91
    assert sum(r.records for r in index) == 91
    assert sum(r.boxes for r in index) == sum(v[3] for v in rows.values())
    largest = max(v[2] for v in rows.values())
    assert all(r.bytes < 1500 + largest for r in index)
    for split in ("train", "val"):
        mine = sorted((v[1], v[0], v[2]) for k, v in rows.items() if k[0] == split)
        end = 0
        for place, shard, size in mine:
            assert place == end and shard == place // 1500
            end += size


def test_reruns_over_other_partitions_give_the_same_shards(spark, tmp_path):
    for name, parts in (("a", 1), ("b", 9)):
        shards.write_training_shards(*some(spark, parts=parts), f"{tmp_path}/{name}", 1000)
    assert written(spark, f"{tmp_path}/a") == written(spark, f"{tmp_path}/b")
    shards.write_training_shards(*some(spark), f"{tmp_path}/c", 1000, seed=1)
    assert written(spark, f"{tmp_path}/a") != written(spark, f"{tmp_path}/c")


def test_long_label_files_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(shards, "PART_LINES", 100)
    images, labels = some(spark)
    got = shards.training_records(images, labels, "train").where("filename = 'hot.png'").collect()
    lines = {r.part: [b.line_no for b in r.boxes] for r in got}
    assert set(lines) <= {0, 1, 2}
    assert all(part * 100 < n <= part * 100 + 100 for part, ns in lines.items() for n in ns)
    assert all(ns == sorted(ns) for ns in lines.values())


def test_refused_sets(spark, tmp_path):
    images, labels = some(spark)
    with pytest.raises(ValueError, match="val"):
        shards.write_training_shards(images.where("split = 'train'"), labels, f"{tmp_path}/a")
    with pytest.raises(ValueError, match="positive"):
        shards.write_training_shards(images, labels, f"{tmp_path}/b", 0)


def test_very_long_numbers_in_label_lines(spark):
    number = "1" + "_1" * 200_000
    lines = spark.createDataFrame([("train", "a", 1, f"{number} 0.5 0.5 0.1 0.1"), ("train", "a", 2, f"0 {number}.5 1 1 1")], LINES)
    assert store.valid_labels(store.parse_label_lines(lines)).count() == 0


def test_small_shards_share_folders_and_large_ones_have_their_own(spark, tmp_path, monkeypatch):
    images, labels = some(spark)
    rows = {}
    for name, most in (("one", 1 << 20), ("some", 4000), ("own", 10)):
        monkeypatch.setattr(shards, "FOLDER_BYTES", most)
        index = shards.write_training_shards(images, labels, f"{tmp_path}/{name}", 1000).collect()
        rows[name] = written(spark, f"{tmp_path}/{name}")
        folders = {(p.parent.name, p.name) for p in (tmp_path / name / "records").glob("split=*/shards=*")}
        each = max(1, most // 1000)
        assert folders == {(f"split={r.split}", f"shards={r.shard - r.shard % each}") for r in index}
    assert rows["one"] == rows["some"] == rows["own"]
