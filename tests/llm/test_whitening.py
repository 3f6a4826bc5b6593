import math

import numpy as np
import pytest

from boxframe.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, components=4):
    """Rows by numpy: (vec_id, component) to a list of (n, deviation, |whitened|, explained)."""
    usable = [
        (i, [math.floor(256 * float(np.float32(c))) for c in v])
        for i, v in rows
        if v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    size = max((len(v) for _, v in usable), default=0)
    usable = [(i, tuple(v) + (0,) * (size - len(v))) for i, v in usable]
    fit = sorted({v for _, v in usable})
    out = []
    if not fit or not size:
        return out
    n = len(fit)
    sums = [sum(v[j] for v in fit) for j in range(size)]
    x = np.array(fit, float) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(x.T @ x / n)
    order = np.argsort(-values)[:components]
    for i, v in usable:
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))
        for k, at in enumerate(order, 1):
            if values[at] > values.max() * 1e-12:
                w = (np.array(v) - np.array(sums) / n) @ vectors[:, at] / math.sqrt(values[at])
                out.append((i, k, n, deviation, abs(w), values[at] / values.sum()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


def got(df):
    rows = whitening.whitened(df).collect()
    assert all(0 <= r.identity_error <= 1e-4 for r in rows)
    out = [(r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in rows]
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


def same(a, b):
    assert [r[:4] for r in a] == [r[:4] for r in b]
    for r, s in zip(a, b, strict=True):
        assert r[4:] == pytest.approx(s[4:], rel=1e-7, abs=1e-9)


def made(rng, n, d):
    return [(i, rng.normal(0, 1 + np.arange(d) % 5, d).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("block", [whitening.BLOCK_BYTES, 2000])
def test_rows_match_numpy(spark, monkeypatch, block):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", block)
    rng = np.random.default_rng(5)
    rows = made(rng, 400, 12)
    rows += [(1000 + i, rows[3][1]) for i in range(200)]
    rows += [(3, rows[9][1]), (None, rows[5][1]), (None, None), (7, None), (8, [None] * 12)]
    rows += [(9, [float("nan")] * 12), (10, [float("inf")] + [0.0] * 11), (11, [0.0] * 12), (12, [-0.0] * 12)]
    same(got(spark.createDataFrame(rows, SCHEMA)), plain(rows))


def test_panels_and_column_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = made(rng, 300, 10)
    want = plain(rows)
    monkeypatch.setattr(whitening, "PANEL", 70)
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 4)
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 1000)
    same(got(spark.createDataFrame(rows, SCHEMA)), want)


def test_short_vectors_end_in_zeros(spark):
    rng = np.random.default_rng(7)
    rows = made(rng, 60, 5) + [(100, []), (101, [0.0]), (102, [1.0, 2.0]), (103, [1.0, 2.0, 0.0, 0.0, 0.0])]
    same(got(spark.createDataFrame(rows, SCHEMA)), plain(rows))


def test_few_directions_and_nothing_to_fit(spark):
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(30)]
    same(got(spark.createDataFrame(line, SCHEMA)), plain(line))
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)]):
        assert got(spark.createDataFrame(rows, SCHEMA)) == []


def test_huge_entries_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = [(i, [float(i % 7), float(i % 3)]) for i in range(20)] + [(50, [3e38, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.withColumns({c: F.lit("own") for c in ("x", "key", "index", "z", "component", "n", "_id")})
    found = whitening.whitened(df).collect()
    # The second direction is lost to rounding beside the first, and sums leave 64 bits.
    assert len(found) == 21 and {r.component for r in found} == {1}
    assert {r.deviation for r in found} == {None}


def test_refuses_very_long_vectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MOST_DIMENSIONS", 3)
    with pytest.raises(ValueError):
        whitening.whitened(spark.createDataFrame([(1, [1.0] * 4)], SCHEMA))
