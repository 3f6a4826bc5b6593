"""Touch degrees, as-of joins and streamed tails against plain loops."""

import math
import random

import pytest

from boxframe.operators import asof, degree
from boxframe.streaming import tails
from pyspark.sql import functions as F

BOXES = "image_id long, det_idx int, x1 double, y1 double, x2 double, y2 double"


def plain_degrees(rows):
    def sound(r):
        return all(v is not None and math.isfinite(v) for v in r[2:]) and r[2] <= r[4] and r[3] <= r[5]

    out = {}
    for a in rows:
        met = [
            b for b in rows
            if b is not a and a[0] == b[0] and sound(a) and sound(b)
            and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5]
        ]
        out[a[:2]] = len(met)
    return out


def test_degrees_equal_all_pairs(spark):
    rng = random.Random(2)
    rows = []
    for image in (1, 2, None):
        for i in range(250 if image == 1 else 20):
            x, y = rng.randrange(60) / 4, rng.randrange(60) / 4
            rows.append((image, i, x, y, x + rng.randrange(12) / 8, y + rng.randrange(12) / 8))
    rows += [(1, 900 + i, *rows[7][2:]) for i in range(15)]
    odd = [(None, 1.0, 2.0, 2.0), (0.0, float("nan"), 2.0, 2.0), (0.0, 0.0, float("inf"), 9.0), (5.0, 5.0, 1.0, 9.0), (-0.0, 0.0, 0.0, 0.0)]
    rows += [(1, 950 + i, *b) for i, b in enumerate(odd)]
    df = spark.createDataFrame(rows, BOXES).repartition(3)
    got = {(r.image_id, r.det_idx): r.degree for r in degree.touch_degrees(df).collect()}
    want = plain_degrees(rows)
    assert got == want and max(want.values()) > 15
    large = degree.touch_degrees(df, limit=5)
    assert {(r.image_id, r.det_idx): r.degree for r in large.collect()} == want
    assert large.dtypes == degree.touch_degrees(df).dtypes
    assert degree.touch_degrees(df.limit(0)).collect() == []


def test_degrees_of_small_images_write_nothing(spark, monkeypatch):
    monkeypatch.setattr(degree, "durable", lambda *a: pytest.fail("rows were written"))
    rows = [(i % 7, i, i % 9 * 2.0, i % 5 * 2.0, i % 9 * 2.0 + 3, i % 5 * 2.0 + 2) for i in range(140)]
    got = degree.touch_degrees(spark.createDataFrame(rows, BOXES)).collect()
    assert {(r.image_id, r.det_idx): r.degree for r in got} == plain_degrees(rows)


def test_many_boxes_on_one_spot(spark):
    spot = spark.range(100_000).select(
        F.lit(1).cast("long").alias("image_id"), F.col("id").cast("int").alias("det_idx"),
        *[F.lit(v).alias(c) for c, v in (("x1", 1.0), ("y1", 1.0), ("x2", 2.0), ("y2", 2.0))],
    )
    other = spark.createDataFrame([(1, -1, 2.0, 2.0, 3.0, 3.0), (1, -2, 5.0, 5.0, 6.0, 6.0)], BOXES)
    got = degree.touch_degrees(spot.unionByName(other)).groupBy("degree").count().collect()
    assert sorted(map(tuple, got)) == [(0, 1), (100_000, 100_001)]


def plain_asof(left, right, within=None):
    out = []
    for k, t, i in left:
        found = [r for r in right if r[0] == k and r[1] is not None and t is not None and r[1] <= t]
        best = max(found, key=lambda r: (r[1], r[2]), default=None)
        if best and within is not None and t - best[1] > within:
            best = None
        out.append((k, t, i, best[2:] if best else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("within", [None, 2.5])
def test_asof_equals_the_loop(spark, within):
    rng = random.Random(4)
    keys = ["hot"] * 6 + ["a", "b", None]
    left = [(rng.choice(keys), None if i % 50 == 0 else rng.randrange(800) / 4, i) for i in range(700)]
    right = [(rng.choice(keys[:8]), rng.randrange(800) / 4, i, f"r{i}") for i in range(300)] + [("hot", None, 999, "x")]
    left += [("only left", 1.0, 5000), ("hot", 10.0, 5001), ("hot", 10.0, 5001)]
    a = spark.createDataFrame(left, "k string, t double, i long")
    b = spark.createDataFrame(right, "k string, t double, i long, name string")
    rows = asof.asof_join(a, b, ["k"], "t", "i", within).collect()
    got = sorted(((r.k, r.t, r.i, (r.match.i, r.match.name) if r.match else None) for r in rows), key=repr)
    assert got == plain_asof(left, right, within) and sum(r[3] is not None for r in got) > 400
    empty = asof.asof_join(a, b.limit(0), ["k"], "t", "i").collect()
    assert len(empty) == len(left) and all(r.match is None for r in empty)


LINES = "run string, seq long, line string"


def test_tails_stay_bounded_and_survive_a_restart(spark, tmp_path):
    root, sent = str(tmp_path), []
    batches = [
        [("a", i, f"a{i}") for i in range(500)] + [("b", 1, "\x1b[1mb1\x1b[0m")],
        [("a", 3, "too old"), ("b", 3, "b3"), ("b", None, "no place"), (None, 1, "nobody")],
        [("a", i, f"a{i}") for i in range(500, 507)] + [("b", 2, "b2"), ("b", 3, "b3 again")],
    ]
    for batch in batches:
        spark.createDataFrame(batch, LINES).coalesce(1).write.mode("append").parquet(f"{root}/in")
        sent += batch
        # Each call goes on from the checkpoint of the one before.
        stream = spark.readStream.schema(LINES).parquet(f"{root}/in")
        tails.follow_tails(stream, f"{root}/out", f"{root}/cp", shown=3, kept=20).awaitTermination()
    got = sorted(map(tuple, tails.read_tails(spark, f"{root}/out").collect()), key=repr)
    want = [("a", i, f"a{i}") for i in (504, 505, 506)] + [("b", 1, "b1"), ("b", 2, "b2"), ("b", 3, "b3 again"), (None, 1, "nobody")]
    assert got == sorted(want, key=repr)
    state = spark.read.format("statestore").option("path", f"{root}/cp").option("stateVarName", "lines").load()
    held = {r[0]: r[1] for r in state.groupBy("key.run").count().collect()}
    assert held == {"a": 20, "b": 3, None: 1}
    with pytest.raises(ValueError):
        tails.follow_tails(stream, root, root, shown=5, kept=4)
