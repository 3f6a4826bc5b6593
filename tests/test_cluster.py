import random
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxframe.operators import cluster
from boxframe.operators.graph import connected_components

SCHEMA = (
    "image_id long, det_idx int, class_id int, x1 double, y1 double, x2 double,"
    " y2 double, confidence double, class_name string"
)


def brute(boxes, size, margin, min_size, is_source, target_id):
    """The merge of one image as nested loops."""
    sources = [b for b in boxes if is_source(b)]
    as_row = lambda b: (*b[3:7], b[7], b[2], b[8], 1, b[1])
    if min_size < 2 or len(sources) < min_size:
        return [as_row(b) for b in boxes]
    grow = margin * max(size)
    group = list(range(len(sources)))
    for i, a in enumerate(sources):
        for j in range(i):
            b = sources[j]
            if (
                a[3] - grow <= b[5] + grow
                and b[3] - grow <= a[5] + grow
                and a[4] - grow <= b[6] + grow
                and b[4] - grow <= a[6] + grow
            ):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    out = []
    for g in sorted(set(group)):
        members = [s for s, h in zip(sources, group) if h == g]
        if len(members) < min_size:
            out += [as_row(b) for b in members]
            continue
        out.append(
            (
                min(b[3] for b in members),
                min(b[4] for b in members),
                max(b[5] for b in members),
                max(b[6] for b in members),
                sum(b[7] for b in members) / len(members),
                target_id,
                "cluster",
                len(members),
                members[0][1],
            )
        )
    out += [as_row(b) for b in boxes if not is_source(b)]
    return sorted(out, key=lambda r: -r[4])


def expected(boxes, size, margin=0.01, min_size=3):
    out = []
    for image, group in groupby(sorted(boxes), key=lambda b: b[0]):
        merged = brute(list(group), size, margin, min_size, lambda b: b[2] == 0, 1)
        out += [(image, i, *r) for i, r in enumerate(merged)]
    return out


def merge(spark, boxes, size, **more):
    more.setdefault("target_class_name", "cluster")
    out = cluster.merge_clusters(spark.createDataFrame(boxes, SCHEMA), size, **more)
    return sorted(tuple(r) for r in out.collect())


def scatter(images, count, spread, side, seed):
    rng = random.Random(seed)
    out = []
    for image in range(images):
        for i in range(count):
            x, y = rng.randrange(spread), rng.randrange(spread)
            w, h = rng.randrange(1, side), rng.randrange(1, side)
            out.append(
                (image, i, int(rng.random() < 0.3), float(x), float(y), float(x + w),
                 float(y + h), rng.randrange(1024) / 1024, "n")
            )
    return out


@pytest.mark.parametrize("square", [0, 256])
def test_both_ways_of_grouping(monkeypatch, square):
    monkeypatch.setattr(cluster, "SQUARE", square)
    import numpy as np

    rng = np.random.default_rng(1)
    for count in (0, 1, 2, 40, 120):
        x, y = rng.integers(0, 300, (2, count)).astype(float)
        w, h = rng.integers(0, 30, (2, count))
        got = cluster._touching_groups(x, y, x + w, y + h)
        group = list(range(count))
        for i in range(count):
            for j in range(i):
                if abs(2 * x[i] + w[i] - 2 * x[j] - w[j]) <= w[i] + w[j] and abs(
                    2 * y[i] + h[i] - 2 * y[j] - h[j]
                ) <= h[i] + h[j]:
                    low, high = sorted((group[i], group[j]))
                    group = [low if g == high else g for g in group]
        assert list(got) == group


def line(*corners, cls=0, conf=None):
    conf = conf or [0.5] * len(corners)
    return [
        (0, i, cls, *map(float, c), conf[i], "n") for i, c in enumerate(corners)
    ]


def test_touching_and_chain(spark):
    # margin 0.01 of 100 grows each box by 1, so boxes 2 apart touch
    boxes = line((0, 0, 10, 10), (12, 0, 22, 10), (24, 0, 34, 10))
    got = merge(spark, boxes, (100, 50))
    assert got == [(0, 0, 0.0, 0.0, 34.0, 10.0, 0.5, 1, "cluster", 3, 0)]
    apart = line((0, 0, 10, 10), (12.1, 0, 22, 10), (24, 0, 34, 10))
    assert len(merge(spark, apart, (100, 50))) == 3


def test_too_few_keeps_input_order(spark):
    boxes = line((0, 0, 10, 10), (5, 0, 15, 10), conf=[0.1, 0.9])
    got = merge(spark, boxes, (100, 50))
    assert [r[6] for r in got] == [0.1, 0.9]
    many = line(*[(0, 0, 10, 10)] * 4, conf=[0.1, 0.9, 0.2, 0.3])
    assert [r[6] for r in merge(spark, many, (100, 50), min_size=1)] == [0.1, 0.9, 0.2, 0.3]


def test_mean_is_taken_before_the_filter(spark):
    boxes = line(*[(0, 0, 10, 10)] * 3, conf=[0.25, 0.875, 0.875])
    got = [r for r in merge(spark, boxes, (100, 50)) if r[6] >= 0.6]
    assert len(got) == 1 and got[0][6] == 2.0 / 3


@pytest.mark.parametrize("limit", [1000, 10])
@pytest.mark.parametrize("side", [12, 40])
def test_equals_loops(spark, limit, side):
    boxes = scatter(4, 60, 200, side, seed=side)
    got = merge(spark, boxes, (200, 100), limit=limit)
    assert got == expected(boxes, (200, 100))


def test_one_large_image_with_copies_and_giants(spark):
    boxes = scatter(1, 500, 900, 8, seed=3)
    boxes += [(0, 500 + i, 0, 5.0, 5.0, 9.0, 9.0, 0.5, "n") for i in range(150)]
    boxes += [(0, 650, 0, 0.0, 400.0, 908.0, 401.0, 0.25, "n")]
    boxes += [(0, 651 + i, 0, 100.0 + i / 8, 0.0, 100.0 + i / 8, 90.0, 0.5, "n") for i in range(60)]
    got = merge(spark, boxes, (900, 900), margin=0.0, limit=25)
    assert got == expected(boxes, (900, 900), margin=0.0)


def test_sizes_as_table(spark):
    boxes = scatter(3, 40, 200, 20, seed=5)
    sizes = spark.createDataFrame([(i, 200, 100) for i in range(3)], "image_id long, width int, height int")
    assert merge(spark, boxes, sizes) == expected(boxes, (200, 100))
    assert merge(spark, boxes, sizes, limit=10) == expected(boxes, (200, 100))


def test_components_of_a_long_path(spark):
    edges = [(0, i, i + 1) for i in range(200)] + [(1, 5, 5), (1, 8, 7)]
    got = connected_components(spark.createDataFrame(edges, "k long, src int, dst int"), ["k"])
    labels = {(r.k, r.node): r.comp for r in got.collect()}
    assert all(labels[0, i] == 0 for i in range(201))
    assert labels[1, 5] == 5 and labels[1, 7] == 7 and labels[1, 8] == 7


def rounds_of(monkeypatch, spark, boxes, limit):
    """Components, rounds of cutting, and the most cells a round had."""
    cuts, cells = [], []
    cut = cluster._cut_cells

    def counted(todo, cell):
        out = cut(todo, cell)
        cuts.append(1)
        cells.append(out.select(*cell).distinct().count())
        return out

    monkeypatch.setattr(cluster, "_cut_cells", counted)
    df = spark.createDataFrame(boxes, "image_id long, det_idx int, x1 double, y1 double, x2 double, y2 double")
    got = {r.det_idx: r.comp for r in cluster.box_components(df, limit).collect()}
    return got, len(cuts), max(cells, default=0)


def test_boxes_that_end_on_one_line(spark, monkeypatch):
    rng = random.Random(5)
    boxes = [(0, i, 100.0 - rng.random() * 50, rng.random() * 300, 100.0, 0.0) for i in range(5000)]
    boxes = [(*b[:5], b[3] + 5 + rng.random()) for b in boxes]
    boxes += [(0, 5000 + i, 500.0 + 3 * i, 0.0, 501.0 + 3 * i, 1.0) for i in range(50)]
    got, cuts, cells = rounds_of(monkeypatch, spark, boxes, 50)
    assert len(set(got.values())) == 51 and got[4999] == 0
    assert cuts <= 8 and cells <= 20000


def test_thin_boxes_that_cross(spark, monkeypatch):
    n = 60
    boxes = [(0, i, 0.0, 10.0 * i, 1000.0, 10.0 * i + 1) for i in range(n)]
    boxes += [(0, n + i, 10.0 * i, -5.0, 10.0 * i + 1, 1000.0) for i in range(n)]
    got, cuts, cells = rounds_of(monkeypatch, spark, boxes, 15)
    assert set(got.values()) == {0} and len(got) == 2 * n
    # No more cells than a few per crossing.
    assert cuts <= 10 and cells <= 10 * n * n


def test_same_rows_at_every_limit(spark):
    """Boxes without a class, images without a size: nothing is lost on either way."""
    boxes = [(i % 3, i, (i * 7) % 50 * 1.0, 0.0, (i * 7) % 50 + 9.0, 9.0, i / 64, None if i % 4 == 3 else i % 2) for i in range(60)]
    df = spark.createDataFrame(boxes, "image_id long, det_idx int, x1 double, y1 double, x2 double, y2 double, confidence double, class_id int")
    sizes = spark.createDataFrame([(0, 100, 50), (1, 100, 50)], "image_id long, width int, height int")
    rows = [sorted(map(tuple, cluster.merge_clusters(df, sizes, limit=k).collect()), key=repr) for k in (1000, 5)]
    assert rows[0] == rows[1]
    assert sum(r[9] for r in rows[0]) == len(boxes)


def test_components_of_few_edges_take_no_rounds(spark, monkeypatch):
    from boxframe.operators import graph

    rng = random.Random(5)
    edges = [(k % 40, rng.randrange(30), rng.randrange(30)) for k in range(700)]
    edges += [(None, 4, 9), (None, 9, 1), (50, 3, 3), (51, None, 2), (51, 2, 6), (51, 6, 2)]
    df = spark.createDataFrame(edges, "k long, src int, dst int")
    rows = lambda **more: sorted(map(tuple, connected_components(df, ["k"], **more).collect()), key=repr)
    rounds = rows(limit=1)
    monkeypatch.setattr(graph, "durable", lambda *a: pytest.fail("rows were written"))
    assert rows() == rounds
    names = df.selectExpr("k", "concat('é', src) src", "concat('é', dst) dst")
    assert {(r.k, r.node, r.comp) for r in connected_components(names.where("k is null"), ["k"]).collect()} == {
        (None, "é1", "é1"), (None, "é4", "é1"), (None, "é9", "é1")
    }


def test_small_keys_are_numbered_without_ranges(spark, monkeypatch):
    from boxframe.operators import groups

    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 2, 3, 4]), i if i % 7 else None) for i in range(55)]
    df = spark.createDataFrame(rows, "k int, v int").dropDuplicates()
    numbered = lambda limit: groups.rank_large(df, ["k"], [F.col("v")], "n", limit)
    ranged = numbered(1)
    want = sorted(map(tuple, ranged.collect()), key=repr)
    monkeypatch.setattr(groups, "_rank_ranges", lambda *a: pytest.fail("rows were ranged"))
    assert numbered(100).dtypes == ranged.dtypes
    assert sorted(map(tuple, numbered(100).collect()), key=repr) == want


def random_boxes(rng, n, side=400):
    at = rng.integers(0, side, (n, 2)).astype(float)
    boxes = np.hstack([at, at + rng.integers(0, 30, (n, 2))])
    boxes[:: n // 3] = [0, 50, side, 51]
    boxes[3::7] = boxes[2]
    return boxes


def test_cells_of_one_task_give_the_groups_of_all_pairs():
    rng = np.random.default_rng(1)
    for n, limit in ((9, 1), (80, 4), (700, 60), (700, 3)):
        corners = list(random_boxes(rng, n, 40 * int(n**0.5)).T)
        got = cluster._groups_by_cells(corners, limit)
        assert np.array_equal(got, cluster._touching_groups(*corners))


def test_images_of_one_task_write_nothing(spark, monkeypatch):
    """Images above the limit are solved in one shuffle, as by the cells of all tasks."""
    rng = np.random.default_rng(2)
    rows = [(i, k, *map(float, b)) for i, n in ((1, 90), (2, 5), (3, 40)) for k, b in enumerate(random_boxes(rng, n))]
    df = spark.createDataFrame(rows, "image_id long, det_idx int, x1 double, y1 double, x2 double, y2 double")
    dets = df.selectExpr("*", "det_idx / 100 as confidence", "cast(det_idx % 4 = 3 as int) as class_id")

    def both():
        merged = cluster.merge_clusters(dets, (400, 400), limit=8)
        return [sorted(map(repr, t.collect())) for t in (cluster.box_components(df, 8), merged)]

    with monkeypatch.context() as m:
        m.setattr(cluster, "IMAGE_ROWS", 0)
        by_all = both()
    monkeypatch.setattr(cluster, "durable", None)
    assert both() == by_all


def test_more_rows_are_dealt_to_more_tasks(spark, monkeypatch):
    from boxframe.operators import groups

    df = spark.range(4000).selectExpr("id % 2 as k", "(id * 7919) % 4000 as v")
    monkeypatch.setattr(groups, "TASK_ROWS", 100)
    assert groups.in_ranges(df, 4000, ["k", "v"]).select("_range").distinct().count() > 30
    for limit in (10, 4000):
        got = groups.rank_large(df, ["k"], [F.col("v")], "n", limit)
        part = got.withColumn("p", F.spark_partition_id()).groupBy("p").count().agg(F.max("count")).first()[0]
        assert part <= (400 if limit == 10 else 2000)
        for k in (0, 1):
            rows = got.where(F.col("k") == k).orderBy("v").collect()
            assert [r.n for r in rows] == list(range(2000))
