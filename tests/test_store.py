import datetime
import random

import pytest

from boxframe.functions import text
from boxframe.operators import classes as cl
from boxframe.operators import naming, store
from boxframe.operators.naming import unique_names
from boxframe.schema import DetectorParams, require_every
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

LINES = "split string, stem string, line_no int, line string"
IMAGES = "split string, filename string, created_at timestamp"
T0 = datetime.datetime(2024, 1, 1)


def when(n):
    return T0 + datetime.timedelta(seconds=n)


@pytest.mark.parametrize(
    "line,fault",
    [
        ("0 0.5 0.5 0.1 0.1", None),
        ("  3\t0.5 1 1 1e-3 ", None),
        ("1_0 0.5 0.5 1_0e-2 .1", None),
        ("", "blank"),
        (" \t ", "blank"),
        ("0 0.5 0.5 0.1", "arity"),
        ("0 0.5 0.5 0.1 0.1 9", "arity"),
        ("x 0.5 0.5 0.1 0.1", "number"),
        ("0.0 0.5 0.5 0.1 0.1", "number"),
        ("0 0.5d 0.5 0.1 0.1", "number"),
        ("0 nan 0.5 0.1 0.1", "number"),
        ("-1 0.5 0.5 0.1 0.1", "range"),
        ("0 1.01 0.5 0.1 0.1", "range"),
        ("0 0.5 0.5 0 0.1", "range"),
        ("0 0.5 0.5 0.1 1.5", "range"),
    ],
)
def test_label_lines(spark, line, fault):
    df = spark.createDataFrame([("train", "a", 1, line)], LINES)
    assert store.parse_label_lines(df).first().fault == fault


def test_raw_and_valid_counts_and_shared_stem(spark):
    lines = spark.createDataFrame(
        [("train", "a", 1, "0 0.5 0.5 0.1 0.1"), ("train", "a", 2, "0 0.5"), ("train", "a", 3, " ")], LINES
    )
    images = spark.createDataFrame(
        [("train", "a.png", when(1)), ("train", "a.jpg", when(2)), ("val", "b.png", when(3))], IMAGES
    )
    entries = store.newest_first(store.list_entries(images, lines)).collect()
    assert [(e.filename, e.num_boxes) for e in entries] == [("b.png", 0), ("a.jpg", 2), ("a.png", 2)]
    found, boxes = store.find_entries(
        spark.createDataFrame([("a.png",), ("none.png",)], "filename string"),
        images,
        lines,
    )
    assert [(e.filename, e.split, e.num_boxes) for e in found.collect()] == [("a.png", "train", 1)]
    assert boxes.count() == 1
    stats = {r.split: (r.images, r.boxes) for r in store.dataset_stats(images, lines).collect()}
    assert stats == {"train": (2, 4), "val": (1, 0), "test": (0, 0), "total": (3, 4)}
    keys = spark.createDataFrame([("train", "a.jpg"), ("dev", "b.png")], "split string, filename string")
    left, labels = store.delete_entries(images, lines, keys)
    assert sorted(r.filename for r in left.collect()) == ["a.png", "b.png"]
    assert labels.count() == 0
    assert store.list_entries(images, lines, "other").count() == 0


def test_ready(spark):
    def stats(train, val):
        return spark.createDataFrame([("train", train, 0), ("val", val, 0)], "split string, images int, boxes int")

    assert tuple(store.training_ready(stats(5, 0)).first()) == (False, "no images in val")
    assert tuple(store.training_ready(stats(0, 0)).first()) == (False, "no images in train")
    assert tuple(store.training_ready(stats(1, 1)).first()) == (True, None)


def one_by_one(existing, asked):
    names, out = set(existing), []
    for req, name in asked:
        final, n = name, 1
        base, ext = name.rsplit(".", 1)
        while final in names:
            final, n = f"{base} - {n}.{ext}", n + 1
        names.add(final)
        out.append((req, name, final))
    return sorted(out)


@pytest.mark.parametrize("seed", [4, 5])
def test_names(spark, seed):
    existing = ["a.png", "a - 2.png", "b - 1.png", "d.png", "d - 01.png"] + [f"c - {n}.png" for n in range(1, 40, 3)] + ["c.png"]
    rng = random.Random(seed)
    pool = ["a.png", "a - 1.png", "a - 1 - 1.png", "b.png", "c.png", "d.png", "d - 01.png", "e.png"]
    pool += [f"{s} - {rng.randrange(1, 60)}.png" for s in "abcde" for _ in range(3 * (seed - 4))]
    pool += [f"a - {n} - {n % 3 + 1}.png" for n in range(1, 9)] + [f"a - {'9' * 25}.png"]
    asked = [(i, rng.choice(pool)) for i in range(300)]
    got = unique_names(
        spark.createDataFrame([(n,) for n in existing], "filename string"),
        spark.createDataFrame(asked, "req_id long, filename string"),
    )
    assert sorted(map(tuple, got.collect())) == one_by_one(existing, asked)
    assert ("a - 1.png") in one_by_one(existing, [(0, "a.png")])[0]


def test_save(spark):
    images = spark.createDataFrame([("val", "a.png", when(0))], IMAGES)
    ok = '[{"class_id":0,"cx":0.5,"cy":0.5,"w":0.1,"h":0.1}]'
    data = [
        (1, "train", ok, True, "a.jpg"),
        (2, "dev", ok, True, "a.jpg"),
        (3, "train", "[{", True, "a.jpg"),
        (4, "train", '{"a":1}', True, "a.jpg"),
        (5, "train", ok.replace("0.1}", "0}"), True, "a.jpg"),
        (6, "train", '[{"class_id":0,"cx":0.5,"cy":0.5,"w":0.1}]', True, "a.jpg"),
        (7, "train", ok, False, "a.jpg"),
        (8, "train", ok, True, "../a.jpg"),
        (9, "test", "[]", True, None),
        (10, "test", "[3]", True, "x.png"),
        (11, "test", "[]", True, "a.png"),
    ]
    requests = spark.createDataFrame(
        [(*r, when(r[0])) for r in data],
        "req_id long, split string, boxes string, has_image boolean, filename string, ts timestamp",
    )
    saved, labels, rejects = store.save_annotations(images, requests)
    assert sorted((r.req_id, r.split, r.filename, r.num_boxes) for r in saved.collect()) == [
        (1, "train", "a - 1.png", 1),
        (9, "test", "img_%d.png" % (1704067209 * 1000), 0),
        (11, "test", "a - 2.png", 0),
    ]
    assert [tuple(r) for r in labels.collect()] == [("train", "a - 1", 1, 0, 0.5, 0.5, 0.1, 0.1)]
    assert {r.req_id: r.fault for r in rejects.collect()} == {
        2: "split", 3: "json", 4: "not a list", 5: "box", 6: "box", 7: "no image", 8: "filename", 10: "box",
    }


def test_classes(spark):
    assert [tuple(r) for r in cl.vocabulary(spark, {5: "y", 0: "x"}).collect()] == [(0, "x"), (1, "y")]
    assert cl.names_of(None) == ["ecoli"] and cl.names_of("names: [a, b]") == ["a", "b"]
    assert cl.names_of("names: {1: b, 0: a}") == ["a", "b"] and cl.names_of(": [") == ["ecoli"]
    old = cl.vocabulary(spark, ["x", "y"])
    names = spark.createDataFrame(
        [(1, " z "), (2, "z"), (3, "x"), (4, ""), (5, "a b"), (6, "q" * 51), (7, "w")], "ord long, name string"
    )
    new, bad = cl.add_classes(old, names)
    assert sorted(map(tuple, new.collect())) == [(0, "x"), (1, "y"), (2, "z"), (3, "w")]
    assert {r.ord: r.fault for r in bad.collect()} == {
        2: "duplicate", 3: "duplicate", 4: "empty", 5: "characters", 6: "length",
    }
    pairs = spark.createDataFrame([("x", "y"), ("no", "y"), ("y", "new")], "source_name string, target_name string")
    got = {(r.source_name, r.target_name): (r.source_id, r.target_id) for r in cl.resolve_names(pairs, old).collect()}
    assert got == {("x", "y"): (0, 1), ("no", "y"): (None, 1), ("y", "new"): (1, 2)}


def test_text(spark):
    df = spark.createDataFrame(
        [("a.tar.gz", 0.125, 3725), (".png", 0.1225, 61), ("a..png", 0.5, 5), ("n\n", 0.0, 0)],
        "name string, c double, s int",
    )
    got = df.select(
        text.stem("name"), text.suffix("name"), text.png_name("name"), text.valid_file_name("name"),
        text.frame_label(F.lit("n"), "c"), text.percent_label(F.lit("n"), "c"), text.percent_text("c"),
        text.elapsed_text("s"),
    ).collect()
    assert tuple(got[0]) == ("a.tar", ".gz", "a.tar.png", True, "n 0.12", "n 13%", "12.5%", "1h 2m")
    assert tuple(got[1]) == (".png", "", ".png.png", True, "n 0.12", "n 12%", "12.3%", "1m 1s")
    assert tuple(got[2])[:4] == ("a.", ".png", "a..png", True) and got[2][7] == "5s"
    assert not got[3][3]


def test_parameters():
    DetectorParams(classes=("a",))
    for bad in (
        lambda: DetectorParams(classes=()),
        lambda: DetectorParams(classes=("a",), imgsz=100),
        lambda: DetectorParams(classes=("a",), conf_threshold=0.0),
        lambda: require_every(31),
        lambda: require_every(0),
        lambda: text.require_split("dev"),
    ):
        with pytest.raises(ValueError):
            bad()


def test_training_set_is_written_by_split_once_both_have_images(spark, tmp_path):
    images = spark.createDataFrame([("train", "a.png", when(1)), ("train", "b.png", when(2)), ("val", "c.png", when(3))], IMAGES)
    lines = spark.createDataFrame([("train", "a", 1, "0 0.5 0.5 0.1 0.1")], LINES)
    labels = store.valid_labels(store.parse_label_lines(lines))
    store.write_training_set(images, labels, f"{tmp_path}/set")
    rows = spark.read.parquet(f"{tmp_path}/set").collect()
    assert sorted((r.split, r.filename, r.line_no) for r in rows if r.line_no) == [("train", "a.png", 1)]
    assert len(rows) == 3
    with pytest.raises(ValueError, match="val"):
        store.write_training_set(images.where("split = 'train'"), labels, f"{tmp_path}/none")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-2, 40), max_size=60), st.lists(st.integers(0, 60), max_size=6))
def test_maps_of_wins_equal_the_loop(rooms, cuts):
    def loop(wins, rooms):
        for room in rooms:
            wins += wins < room
        return wins

    for start in range(0, 45):
        map_ = naming.WinMap()
        for room in rooms:
            map_.add(room)
        assert naming.wins_after(start, map_.base, map_.flat) == loop(start, rooms)
    wins, bounds = 0, sorted({0, len(rooms), *[min(c, len(rooms)) for c in cuts]})
    for a, b in zip(bounds, bounds[1:], strict=False):
        map_ = naming.WinMap()
        for room in rooms[a:b]:
            map_.add(room)
        wins = naming.wins_after(wins, map_.base, map_.flat)
    assert wins == loop(0, rooms)


def test_runs_of_one_hot_parent(spark, monkeypatch):
    monkeypatch.setattr(naming, "RUN", 7)
    rng = random.Random(3)
    pool = ["a.png"] * 40 + [f"a - {n}.png" for n in range(1, 120)] + ["b.png", "b - 2.png", "a - 3 - 1.png"]
    asked = [(i, rng.choice(pool)) for i in range(400)]
    existing = [f"a - {n}.png" for n in range(5, 90, 9)] + ["b.png"]
    got = naming.unique_names(
        spark.createDataFrame([(n,) for n in existing], "filename string"),
        spark.createDataFrame(asked, "req_id long, filename string"),
    )
    assert sorted(map(tuple, got.collect())) == one_by_one(existing, asked)


def test_mixed_file_names_query(spark):
    from boxframe.plans import QUERIES, store_queries

    sf = "/root/testdata/sf0.001"
    held, _ = store_queries._names(spark, sf)
    rows = QUERIES["mixed_file_names"](spark, sf).collect()
    asked = sorted((r.req_id, r.filename) for r in rows)
    want = one_by_one([r.filename for r in held.collect()], asked)
    assert sorted((r.req_id, r.filename, r.final_name) for r in rows) == want and len(want) > 100


def test_edits_in_one_shuffle_are_those_by_joins(spark, monkeypatch):
    schema = "split string, stem string, line_no int, class_id int"
    rng = random.Random(4)
    keys = [("train", "a"), ("train", "b"), ("val", "a"), (None, "a"), ("val", None)]
    some = lambda n: [(*rng.choice(keys), rng.choice([*range(1, 9), None]), rng.randrange(5)) for _ in range(n)]
    labels, removed = (spark.createDataFrame(some(n), schema) for n in (60, 8))
    # Equal lines would be numbered in any order.
    new = [(*k, n, n) for k in keys for n in rng.sample(range(1, 50), 4)]
    new += [("test", "only", 3, 1)]
    added = spark.createDataFrame(new, schema)
    cleared = spark.createDataFrame([("train", "b"), (None, "a"), ("none", "x")], "split string, stem string")

    def edited(**how):
        return sorted(map(repr, store.edit_boxes(labels, added=added, **how).collect()))

    for how in ({}, {"removed": removed}, {"cleared": cleared}, {"removed": removed, "cleared": cleared}):
        with monkeypatch.context() as m:
            m.setattr(store, "SLICE_ROWS", 0)
            by_joins = edited(**how)
        with monkeypatch.context() as m:
            m.setattr(store, "durable", None)
            assert edited(**how) == by_joins
