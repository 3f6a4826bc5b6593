"""Quantile sketches of durations, kept by day and source and merged."""

import bisect
import random

import pytest

from boxframe.operators import detect

SCHEMA = "source string, day int, inference_ms double"
SHARES = (0.01, 0.25, 0.5, 0.95, 0.99)


def some_runs(n=60_000):
    """One hot source, uneven days, ties, nulls and NaN."""
    rng = random.Random(4)
    rows = []
    for i in range(n):
        source = "hot" if i % 3 else f"s{i % 7}"
        ms = rng.choice([5.0, round(rng.lognormvariate(3, 1), 1), rng.random() * 40])
        rows.append((source, rng.randint(0, 9) ** 2 % 5, ms))
    return rows + [("hot", 0, None), ("hot", 0, float("nan")), (None, 1, 3.0)]


def check(rows, values, error):
    values = sorted(values)
    assert rows["runs"] == len(values)
    assert (rows["least"], rows["greatest"]) == (values[0], values[-1])
    for share, q in zip(SHARES, rows["quantiles"], strict=True):
        assert bisect.bisect_left(values, q) / len(values) <= share + error
        assert bisect.bisect_right(values, q) / len(values) >= share - error


@pytest.mark.parametrize("k", [200, detect.SKETCH_K])
def test_merged_sketches_keep_the_rank_error(spark, k):
    runs = some_runs()
    df = spark.createDataFrame(runs, SCHEMA).repartition(12)
    daily = detect.latency_sketches(df, ["source", "day"], k=k)
    known = [r for r in runs if r[2] is not None and r[2] == r[2]]
    error = 2 * detect.rank_error(k)
    got = {r.source: r for r in detect.sketched_latency(daily, ["source"], SHARES).collect()}
    assert set(got) == {r[0] for r in known}
    for source, row in got.items():
        check(row, [r[2] for r in known if r[0] == source], error)
    check(detect.sketched_latency(daily, (), SHARES).first(), [r[2] for r in known], error)


def test_few_runs_are_exact(spark):
    runs = [("a", d, float(ms)) for d in range(4) for ms in range(1, 26)]
    daily = detect.latency_sketches(spark.createDataFrame(runs, SCHEMA), ["source", "day"])
    row = detect.sketched_latency(daily, ["source"], (0.5,)).first()
    assert (row.runs, row.least, row.greatest, row.quantiles) == (100, 1.0, 25.0, [13.0])


def test_sketches_of_a_hot_source_are_small(spark):
    df = spark.range(400_000).selectExpr("'hot' as source", "cast(id as double) as inference_ms")
    row = detect.latency_sketches(df, ["source"]).selectExpr("length(sketch) as bytes").first()
    assert row.bytes < 40_000


def test_no_runs(spark):
    df = spark.createDataFrame([("a", 1, None)], SCHEMA)
    daily = detect.latency_sketches(df, ["source", "day"])
    assert detect.sketched_latency(daily, ["source"]).collect() == []
    row = detect.sketched_latency(daily).first()
    assert not row.runs and row.least is None and row.quantiles is None
