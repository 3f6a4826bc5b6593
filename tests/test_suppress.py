import random

import pytest

from boxframe.operators.suppress import suppress

SCHEMA = "image_id long, det_idx int, class_id int, x1 double, y1 double, x2 double, y2 double, confidence double"


def overlap(a, b):
    w = max(0.0, min(a[5], b[5]) - max(a[3], b[3]))
    h = max(0.0, min(a[6], b[6]) - max(a[4], b[4]))
    union = (a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - w * h
    return w * h / union if union > 0 else 0.0


def greedy(boxes, threshold, agnostic=False):
    kept = []
    for b in sorted(boxes, key=lambda b: (-b[7], b[1])):
        if not any(
            k[0] == b[0] and (agnostic or k[2] == b[2]) and overlap(k, b) > threshold
            for k in kept
        ):
            kept.append(b)
    return sorted(kept)


def boxes(count, spread, seed):
    rng = random.Random(seed)
    out = []
    for i in range(count):
        x, y = rng.randrange(spread), rng.randrange(spread)
        w, h = rng.randrange(0, 30), rng.randrange(1, 30)
        out.append((rng.randrange(2), i, rng.randrange(2), float(x), float(y), float(x + w), float(y + h), rng.randrange(64) / 64))
    return out + [(0, count + i, 0, 3.0, 3.0, 20.0, 20.0, 0.5) for i in range(20)]


@pytest.mark.parametrize(
    "limit,threshold,agnostic,count",
    [(1000, 0.45, False, 240), (1000, 0.2, True, 240), (1000, 1.0, False, 240),
     (12, 1.0, False, 120), (25, 0.45, False, 160), (30, 0.8, True, 160)],
)
def test_equals_greedy(spark, limit, threshold, agnostic, count):
    data = boxes(count, 60, seed=11)
    df = spark.createDataFrame(data, SCHEMA)
    got = suppress(df, threshold, agnostic=agnostic, limit=limit)
    assert sorted(tuple(r) for r in got.select(*df.columns).collect()) == greedy(data, threshold, agnostic)


@pytest.mark.parametrize("threshold,agnostic", [(0.45, False), (0.2, True), (1.0, False)])
def test_many_tiles_equal_one(spark, monkeypatch, threshold, agnostic):
    from boxframe.operators import suppress as module

    data = boxes(160, 60, seed=7) + [(0, 900 + i, 0, 30.0, 30.0, 10.0, 10.0, 0.9) for i in range(3)]
    data += [(None, 950 + i, None, i * 4.0, 0.0, i * 4.0 + 10, 9.0, 0.5) for i in range(9)]
    df = spark.createDataFrame(data, SCHEMA)
    rows = lambda **more: sorted(map(tuple, suppress(df, threshold, agnostic, **more).collect()), key=repr)
    one, small = rows(limit=8), rows()
    monkeypatch.setattr(module, "TILE_ROWS", 20)
    assert one == small == rows(limit=8)


def test_a_group_of_one_tile_is_neither_copied_nor_written(spark, monkeypatch):
    from boxframe.operators import suppress as module

    monkeypatch.setattr(module, "_reach", lambda *a: pytest.fail("boxes were dealt to tiles"))
    monkeypatch.setattr(module, "durable", lambda *a: pytest.fail("rows were written"))
    data = boxes(120, 60, seed=3)
    got = suppress(spark.createDataFrame(data, SCHEMA), 0.45, limit=5)
    assert sorted(map(tuple, got.collect())) == greedy(data, 0.45)


def test_cap_keeps_the_best(spark):
    data = boxes(60, 400, seed=2)
    got = suppress(spark.createDataFrame(data, SCHEMA), max_per_image=5)
    kept = greedy(data, 0.45)
    for image in (0, 1):
        best = sorted((b for b in kept if b[0] == image), key=lambda b: (-b[7], b[1]))[:5]
        assert sorted(b[1] for b in best) == sorted(
            r.det_idx for r in got.collect() if r.image_id == image
        )


def test_no_class_no_area_and_bad_threshold(spark):
    data = boxes(80, 40, seed=5)
    data = [(*b[:2], None if b[2] else 0, *b[3:]) for b in data]
    data += [(0, 500 + i, 0, 30.0, 30.0, 10.0, 10.0, 0.9) for i in range(30)]
    df = spark.createDataFrame(data, SCHEMA)
    rows = lambda limit: sorted(map(tuple, suppress(df, limit=limit).collect()), key=repr)
    assert rows(1000) == rows(10)
    for threshold in (0.0, 1.5):
        with pytest.raises(ValueError):
            suppress(df, threshold)


def test_a_falling_chain_takes_few_rounds(spark, monkeypatch):
    """Each box beats the next, so box after box is kept and dropped."""
    from boxframe.operators import suppress as module

    data = [(0, i, 0, i * 3.0, 0.0, i * 3.0 + 10.0, 10.0, 1 - i / 400) for i in range(200)]
    rounds = []
    split = module.split_hot
    monkeypatch.setattr(module, "split_hot", lambda *a: rounds.append(1) or split(*a))
    got = suppress(spark.createDataFrame(data, SCHEMA), 0.45, limit=5)
    assert sorted(r.det_idx for r in got.collect()) == [b[1] for b in greedy(data, 0.45)]
    assert len(rounds) <= 10
