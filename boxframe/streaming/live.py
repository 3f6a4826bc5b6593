"""Frame logs, detections and run logs as Structured Streaming jobs.

Each micro-batch runs the batch operators, so a source that fills most of a
batch is still worked on by many tasks. What a source carries over is one row
(frame_state), written per batch beside the results; a batch that is run again
reads the same earlier state and replaces its own output.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_line
from ..operators import frames as fr
from ..operators.detect import predict
from ..operators.groups import BROADCAST_KEYS, SLICE_ROWS, remove, salted_join


def _folder(path, batch):
    return f"{path}/batch={batch}"


def _earlier_state(spark, path, batch):
    return None if batch == 0 else spark.read.parquet(_folder(f"{path}/state", batch - 1))


def _split_late(rows, state):
    """(reads after the last one seen per source, reads that come too late)."""
    if state is None:
        return rows, None
    seen = state.select("source", F.col("last_idx").alias("_last"))
    marked = salted_join(rows, seen, ["source"], "read_idx", "left")
    late = F.coalesce(F.col("read_idx") <= F.col("_last"), F.lit(False))
    return marked.where(~late).drop("_last"), marked.where(late).drop("_last")


def _keep_state(rows, state, path, batch, **settings):
    new = fr.frame_state(rows, state=state, **settings)
    if state is not None:
        new = new.unionByName(state.join(new.select("source"), "source", "left_anti"))
    new.write.mode("overwrite").parquet(_folder(f"{path}/state", batch))
    # A batch that is run again needs the state before it; what is older has served.
    remove(rows.sparkSession, _folder(f"{path}/state", batch - 2))


def frame_batch(rows, batch, path, infer_every=1, streak=fr.EMPTY_FRAMES, entries=fr.RATE_ENTRIES,
                cutoff=fr.FAILED_READS, slice_rows=SLICE_ROWS):
    """One micro-batch of a frame log: results, late reads and state."""
    spark = rows.sparkSession
    state = _earlier_state(spark, path, batch)
    rows, late = _split_late(rows, state)
    settings = dict(entries=entries, cutoff=cutoff, slice_rows=slice_rows)
    log = fr.frame_log(rows, streak=streak, state=state, **settings)
    log = fr.with_infer_frame(log, infer_every)
    log.write.mode("overwrite").parquet(_folder(f"{path}/log", batch))
    if late is not None:
        late.groupBy("source").agg(F.count("*").alias("late")).write.mode(
            "overwrite"
        ).parquet(_folder(f"{path}/late", batch))
    _keep_state(rows, state, path, batch, **settings)
    return log


def follow_frames(stream: DataFrame, path, checkpoint, trigger=None, **settings):
    """Start the frame log of a stream; results go to `path`/log.

    Reads of a source must arrive in order; a read that is not above the last
    one seen is left out and counted in `path`/late. A source that has ended
    stays ended.
    """

    def handle(rows, batch):
        rows.persist()
        frame_batch(rows, batch, path, **settings)
        rows.unpersist()

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def follow_detections(stream, make_scorer, names, merge, path, checkpoint, conf=0.25,
                      infer_every=1, trigger=None, cutoff=fr.FAILED_READS, contrast=None):
    """Score every n-th good frame of each source and merge dense groups.

    `stream` has source, read_idx, ok, dt_s, n_dets and height, width, nChannels,
    data. `contrast` (tiles, clip) equalises each frame first. Detections go to
    `path`/detections by source and frame, frames that could not be scored to
    `path`/unusable; `path`/log says for each frame whose detections it shows.
    """

    def handle(rows, batch):
        spark = rows.sparkSession
        reads = rows.select("source", "read_idx", "ok", "dt_s", "n_dets")
        frame_batch(reads, batch, path, infer_every=infer_every, cutoff=cutoff)
        log = spark.read.parquet(_folder(f"{path}/log", batch))
        due = fr.every_nth(log.where("ok"), infer_every).select(
            "source", "read_idx", "frame_number"
        )
        # Images are not shuffled to find the frames that are due, unless too many are.
        if due.count() <= BROADCAST_KEYS:
            due = F.broadcast(due)
        image = F.concat_ws("/", "source", "frame_number").alias("image_id")
        images = rows.join(due, ["source", "read_idx"]).select(
            image, "height", "width", "nChannels", "data"
        )
        merged, unusable = predict(images, make_scorer, conf, names, merge, contrast)
        kind = rows.schema["source"].dataType
        frame = [
            F.regexp_extract("image_id", r"(?s)^(.*)/\d+$", 1).cast(kind).alias("source"),
            F.regexp_extract("image_id", r"(\d+)$", 1).cast("bigint").alias("frame_number"),
        ]
        merged.select(*frame, *merged.columns[1:]).write.mode("overwrite").parquet(
            _folder(f"{path}/detections", batch)
        )
        unusable.select(*frame).write.mode("overwrite").parquet(
            _folder(f"{path}/unusable", batch)
        )

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_results(spark, path, name="log"):
    """Everything a stream has written under one name so far."""
    return spark.read.parquet(f"{path}/{name}").drop("batch")


def follow_log(stream, path, checkpoint, trigger=None):
    """Clean log lines of a stream and append them to `path`.

    Each line is cleaned on its own, so a bad line does not stop the others. Lines
    keep their `seq`, so the tail of a run is `runs.log_tail` over the sink.
    """
    cleaned = stream.withColumn("line", clean_line("line"))
    writer = cleaned.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
