import random
from collections import deque

import pytest

from boxframe.operators import frames as fr

SCHEMA = "source int, read_idx long, ok boolean, dt_s double, n_dets int"


def simulate(log, entries, cutoff, streak):
    """The live loop over one source's reads."""
    rates, out = deque(maxlen=entries), []
    failed = number = empty = 0
    for source, idx, ok, dt, dets in log:
        if not ok:
            failed += 1
            if failed >= cutoff:
                break
            out.append((source, idx, False, None, failed, None, None, None, None))
            continue
        failed = 0
        number += 1
        shown, alert, resumed = None, None, None
        if dets is not None:
            if dets:
                resumed = empty if empty >= streak else None
                empty = 0
            else:
                empty += 1
            shown, alert = empty, empty > 0 and empty % streak == 0
            if dt > 0:
                rates.append(1 / dt)
        fps = sum(rates) / len(rates) if rates else 0.0
        out.append((source, idx, True, number, 0, fps, shown, alert, resumed))
    return out


def make(sources, count, seed, fail=0.2):
    rng = random.Random(seed)
    out, idx, mood = [], 0, 0.3
    for s in range(sources):
        idx = rng.randrange(5)
        for _ in range(count):
            idx += rng.choice([1, 1, 1, 2, 9])
            if rng.random() < 0.05:
                mood = rng.choice([0.0, 0.05, 0.9])
            dets = None if rng.random() < 0.05 else int(rng.random() < mood)
            out.append((s, idx, rng.random() > fail, rng.choice([0.0, 0.25, 0.5, 0.125]), dets))
    return out


@pytest.mark.parametrize("slice_rows", [7, 40, 1 << 16])
@pytest.mark.parametrize("seed,fail", [(1, 0.2), (2, 0.45), (3, 0.02)])
def test_log_equals_loop(spark, slice_rows, seed, fail):
    data = make(3, 300, seed, fail)
    want = []
    for s in range(3):
        want += simulate([r for r in data if r[0] == s], 6, 5, 4)
    random.Random(0).shuffle(data)
    got = fr.frame_log(
        spark.createDataFrame(data, SCHEMA), entries=6, cutoff=5, streak=4, slice_rows=slice_rows
    ).drop("dt_s", "n_dets")
    got = sorted(tuple(r) for r in got.collect())
    for a, b in zip(got, sorted(want)):
        assert a[:5] == b[:5] and a[6:7] + a[8:] == b[6:7] + b[8:]
        assert bool(a[7]) == bool(b[7])
        assert a[5] == b[5] or abs(a[5] - b[5]) < 1e-9
    assert len(got) == len(want)


@pytest.mark.parametrize("slice_rows", [16, 1 << 16])
def test_batches_with_state_equal_one_run(spark, slice_rows):
    data = make(2, 200, 9)
    cols = ["source", "read_idx", "ok", "frame_number", "fail_streak", "fps", "empty_streak", "alert", "resumed_after"]
    args = dict(entries=6, cutoff=5, slice_rows=slice_rows)
    whole = fr.frame_log(spark.createDataFrame(data, SCHEMA), streak=4, **args).select(*cols)
    state, parts = None, []
    for low, high in ((0, 150), (150, 151), (151, 400), (400, 10**6)):
        batch = spark.createDataFrame([r for r in data if low <= r[1] < high], SCHEMA)
        parts += fr.frame_log(batch, streak=4, state=state, **args).select(*cols).collect()
        new = fr.frame_state(batch, state=state, **args).collect()
        old = [] if state is None else [r for r in state.collect() if r.source not in {n.source for n in new}]
        state = spark.createDataFrame(new + old, fr.frame_state(batch, **args).schema)
    assert sorted(map(tuple, parts), key=repr) == sorted(map(tuple, whole.collect()), key=repr)


def test_settled_and_carried(spark):
    data = [(0, i, True, 0.1, 1) for i in range(1, 6)] + [(1, i, i < 4, 0.1, 1) for i in range(1, 6)]
    data += [(2, 1, True, 0.1, 1)]
    df = spark.createDataFrame(data, SCHEMA)
    good, bad = fr.settled_frame(df)
    assert [(r.source, r.read_idx) for r in good.collect()] == [(0, 4)]
    assert [(r.source, r.read_idx) for r in bad.collect()] == [(1, 4)]
    numbered = fr.number_frames(df.where("source = 0"))
    dets = spark.createDataFrame([(0, 1, "a"), (0, 1, "b"), (0, 2, "x"), (0, 4, "c")], "source int, frame_number long, name string")
    got = fr.carry_detections(numbered, dets, 3).select("frame_number", "name")
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "b"), (4, "c"), (5, "c")]
    shown = fr.detections_per_frame(numbered, dets.where("frame_number < 4"), 3)
    assert sorted(map(tuple, shown.select("frame_number", "shown").collect())) == [(1, 2), (2, 2), (3, 2), (4, 0), (5, 0)]
