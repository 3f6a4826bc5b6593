import os

import numpy as np

from boxframe.operators import frames as fr
from boxframe.operators import runs
from boxframe.schema import ClusterParams
from boxframe.sources.frames import stream_frames, stream_lines
from boxframe.streaming import live
from test_frames import SCHEMA, make


def test_follow_equals_batch_and_counts_late_reads(spark, tmp_path):
    root = str(tmp_path)
    data = make(2, 120, 5)
    args = dict(entries=6, cutoff=5, streak=4, slice_rows=32)
    for low, high in ((0, 90), (90, 200), (200, 10**6)):
        part = [r for r in data if low <= r[1] < high]
        if low:
            part += [r for r in data if r[1] < 20]
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(f"{root}/in")
        stream = stream_frames(spark, f"{root}/in", SCHEMA)
        live.follow_frames(stream, f"{root}/out", f"{root}/cp", **args).awaitTermination()
    whole = fr.frame_log(spark.createDataFrame(data, SCHEMA), **args)
    got = live.read_results(spark, f"{root}/out").select(*whole.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
    # Only what a batch that is run again needs.
    assert sorted(os.listdir(f"{root}/out/state")) == ["batch=1", "batch=2"]
    late = live.read_results(spark, f"{root}/out", "late").groupBy().sum("late").first()[0]
    assert late == 2 * len([r for r in data if r[1] < 20])


def test_detections_and_log_lines(spark, tmp_path):
    def spots():
        return lambda frame: [(x, y, x + 1, y + 1, 0.9, 0) for y, x in zip(*np.nonzero(frame[:, :, 0]))]

    root = str(tmp_path)
    blank, dots = np.zeros((4, 4, 3), np.uint8), np.zeros((4, 4, 3), np.uint8)
    dots[1, 0:3] = 255
    rows = [
        ("cam/1", i, i != 2, 0.5, 1, 4, 4, 3, (dots if i % 2 else blank).tobytes()) for i in range(1, 8)
    ]
    schema = "source string, read_idx long, ok boolean, dt_s double, n_dets int, height int, width int, nChannels int, data binary"
    spark.createDataFrame(rows, schema).write.parquet(f"{root}/in")
    merge = ClusterParams(enabled=True, margin=0.0, min_size=3)
    live.follow_detections(
        stream_frames(spark, f"{root}/in", schema), spots, ["ecoli", "ecoli_cluster"], merge,
        f"{root}/out", f"{root}/cp", infer_every=2,
    ).awaitTermination()
    got = live.read_results(spark, f"{root}/out", "detections").collect()
    # frames 1, 3, 5 are reads 1, 4, 6; of these only read 1 has dots, one cluster
    assert [(r.source, r.frame_number, r.class_name, r.members) for r in got] == [("cam/1", 1, "ecoli_cluster", 3)]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "run 1.txt").write_bytes(b"\x1b[1mone\x1b[0m\ntwo\xff\nthree\n")
    live.follow_log(stream_lines(spark, f"{root}/logs"), f"{root}/lines", f"{root}/cp2").awaitTermination()
    lines = spark.read.parquet(f"{root}/lines").collect()
    assert {r.run for r in lines} == {"run 1.txt"} and len(lines) == 3
    assert "one" in {r.line for r in lines}
    tail = runs.log_tail(spark.read.parquet(f"{root}/lines"), 1).collect()
    assert [(r.seq, r.line) for r in tail] == [(3, "three")]
