"""Frame logs: numbering, cut-off, rates, streaks, carried detections.

A log has one row per read: source, read_idx (rising per source), ok, dt_s and
n_dets (null when detection failed on the frame). A source may hold a large part
of all rows, so its log is cut into slices of read_idx. Running values are taken
inside each slice; one summary row per slice, run over the slices of a source,
supplies what came before.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import require_every
from .groups import SLICE_ROWS

# Entries in the rolling rate, failed reads that end a source,
# empty frames between alerts, reads before a snapshot.
RATE_ENTRIES = 30
FAILED_READS = 30
EMPTY_FRAMES = 150
SETTLE_READS = 4

STATE_COLUMNS = (
    "source",
    "last_idx",
    "base_n",
    "base_f",
    "base_q",
    "seen_ok",
    "seen_hit",
    "halo",
    "rate",
    "cut",
)


def _last_entries(entries, n):
    return F.slice(entries, F.greatest(F.size(entries) - (n - 1), F.lit(1)), n)


def _mean(entries):
    total = F.aggregate(entries, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(entries) > 0, total / F.size(entries))


def _local(frames, entries, cutoff, slice_rows):
    """Running values inside each slice."""
    key = ["source", "_slice"]
    run = Window.partitionBy(*key).orderBy("read_idx")
    sofar = run.rowsBetween(Window.unboundedPreceding, 0)
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    ok, hit = F.col("ok"), F.col("hit")
    # The plain columns are dealt out once; summaries and results both start there.
    dealt = frames.select(
        "source",
        "read_idx",
        "ok",
        "dt_s",
        "n_dets",
        # Never null, so that no filter on it sets the two uses apart.
        F.coalesce(F.floor(F.col("read_idx") / F.lit(slice_rows)), F.lit(0)).alias("_slice"),
    ).repartition(*key)
    rows = (
        dealt.withColumn("ok", F.coalesce("ok", F.lit(False)))
        .withColumn("inferred", ok & F.col("n_dets").isNotNull())
        .withColumn("hit", F.col("inferred") & (F.col("n_dets") > 0))
        .withColumn("entry", F.col("inferred") & F.coalesce(F.col("dt_s") > 0, F.lit(False)))
        .withColumn("value", F.when(F.col("entry"), 1 / F.col("dt_s")))
        .withColumns(
            {
                "pos": F.row_number().over(run).cast("bigint"),
                "f": F.count_if(ok).over(sofar),
                "q": F.count_if(F.col("inferred")).over(sofar),
                "e": F.count_if(F.col("entry")).over(sofar),
            }
        )
    )
    rows = rows.withColumns(
        {
            "ok_pos": F.max(F.when(ok, F.col("pos"))).over(sofar),
            "hit_q": F.max(F.when(hit, F.col("q"))).over(sofar),
            "old_hit_q": F.max(F.when(hit, F.col("q"))).over(before),
            "all_e": F.count_if(F.col("entry")).over(Window.partitionBy(*key)),
        }
    )
    recent = Window.partitionBy(*key, "entry").orderBy("read_idx")
    recent = recent.rowsBetween(-(entries - 1), 0)
    rows = rows.withColumn(
        "_sum", F.when(F.col("entry"), F.sum("value").over(recent))
    )
    return rows.withColumn("_sum", F.last("_sum", ignorenulls=True).over(sofar))


def _summaries(rows, entries, cutoff, state):
    """One row per slice, with what the source had before it."""
    run = F.col("pos") - F.col("ok_pos")
    last = F.col("entry") & (F.col("e") > F.col("all_e") - entries)
    parts = rows.groupBy("source", "_slice").agg(
        F.max("read_idx").alias("last_idx"),
        F.count("*").alias("n"),
        F.max("f").alias("fs"),
        F.max("q").alias("qs"),
        F.max("ok_pos").alias("ok_pos"),
        F.max("hit_q").alias("hit_q"),
        F.min(F.when(F.col("ok"), F.col("pos"))).alias("first_ok"),
        F.min(F.when(run >= cutoff, F.col("pos"))).alias("local_cut"),
        F.transform(
            F.array_sort(F.collect_list(F.when(last, F.struct("e", "value")))),
            lambda v: v["value"],
        ).alias("tail"),
    )
    line = Window.partitionBy("source").orderBy("_slice")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    if state is not None:
        given = ["base_n", "base_f", "base_q", "seen_ok", "seen_hit", "rate", "cut"]
        parts = parts.join(
            state.select(
                "source", *[F.col(c).alias(f"s_{c}") for c in given], F.col("halo").alias("s_halo")
            ),
            "source",
            "left",
        )
    else:
        parts = parts.withColumns(
            {
                **{
                    f"s_{c}": F.lit(None).cast("bigint")
                    for c in ("base_n", "base_f", "base_q", "seen_ok", "seen_hit", "cut")
                },
                "s_rate": F.lit(None).cast("double"),
                "s_halo": F.lit(None).cast("array<double>"),
            }
        )

    def base(column, start):
        return F.coalesce(F.sum(column).over(before), F.lit(0)) + F.coalesce(start, F.lit(0))

    parts = parts.withColumns(
        {
            "base_n": base("n", "s_base_n"),
            "base_f": base("fs", "s_base_f"),
            "base_q": base("qs", "s_base_q"),
        }
    )
    parts = parts.withColumns(
        {
            "seen_ok": F.greatest(
                F.max(F.col("base_n") + F.col("ok_pos")).over(before), "s_seen_ok", F.lit(0)
            ),
            "seen_hit": F.greatest(
                F.max(F.col("base_q") + F.col("hit_q")).over(before), "s_seen_hit", F.lit(0)
            ),
        }
    )
    failing = F.col("base_n") - F.col("seen_ok")
    leading = F.coalesce(F.col("first_ok") - 1, F.col("n"))
    crossing = F.when(
        (failing < cutoff) & (failing + leading >= cutoff), F.lit(cutoff) - failing
    )
    cut = F.col("base_n") + F.least(crossing, F.col("local_cut"))
    parts = parts.withColumn(
        "cut", F.least(F.min(cut).over(Window.partitionBy("source")), "s_cut")
    )
    # Rates before a slice: the last entries of earlier slices that have any.
    filled = Window.partitionBy("source", F.size("tail") > 0).orderBy("_slice")
    filled = filled.rowsBetween(-(entries - 1), -1)
    empty = F.array().cast("array<double>")
    parts = parts.withColumn(
        "halo",
        _last_entries(
            F.concat(
                F.coalesce("s_halo", empty), F.flatten(F.collect_list("tail").over(filled))
            ),
            entries - 1,
        ),
    )
    parts = parts.withColumn("_all", F.concat("halo", "tail"))
    parts = parts.withColumn(
        "end_rate", F.when(F.size("tail") > 0, _mean(_last_entries(F.col("_all"), entries)))
    )
    return parts.withColumn(
        "rate",
        F.coalesce(F.last("end_rate", ignorenulls=True).over(before), "s_rate", F.lit(0.0)),
    )


def _end_state(parts, entries):
    """What the last slice of each source leaves for the next batch."""
    final = Window.partitionBy("source").orderBy(F.desc("_slice"))
    filled = F.max(F.when(F.size("tail") > 0, F.struct("_slice", "_all"))).over(
        Window.partitionBy("source")
    )
    return (
        parts.withColumn("_filled", filled["_all"])
        .withColumn("_n", F.row_number().over(final))
        .where(F.col("_n") == 1)
        .select(
            "source",
            "last_idx",
            (F.col("base_n") + F.col("n")).alias("base_n"),
            (F.col("base_f") + F.col("fs")).alias("base_f"),
            (F.col("base_q") + F.col("qs")).alias("base_q"),
            F.greatest(F.col("base_n") + F.col("ok_pos"), "seen_ok").alias("seen_ok"),
            F.greatest(F.col("base_q") + F.col("hit_q"), "seen_hit").alias("seen_hit"),
            _last_entries(F.coalesce("_filled", "halo"), entries - 1).alias("halo"),
            F.coalesce("end_rate", "rate").alias("rate"),
            "cut",
        )
    )


def frame_log(
    frames: DataFrame,
    entries: int = RATE_ENTRIES,
    cutoff: int = FAILED_READS,
    streak: int = EMPTY_FRAMES,
    slice_rows: int = SLICE_ROWS,
    state: DataFrame | None = None,
) -> DataFrame:
    """All running values of the reads before each source's end.

    Adds frame_number (good reads only), fail_streak, fps (mean rate over the
    last `entries` entries; 0 while there are none), empty_streak, alert at each
    multiple of `streak` empty frames, and resumed_after where detections return
    after at least `streak` of them.
    """
    rows = _local(frames, entries, cutoff, slice_rows)
    parts = _summaries(rows, entries, cutoff, state)
    return _finish(rows, parts, entries, streak)


def frame_state(frames, entries=RATE_ENTRIES, cutoff=FAILED_READS, slice_rows=SLICE_ROWS, state=None):
    """What a following batch of the same sources needs; one row per source."""
    rows = _local(frames, entries, cutoff, slice_rows)
    return _end_state(_summaries(rows, entries, cutoff, state), entries)


def _finish(rows, parts, entries, streak):
    carried = parts.select(
        "source", "_slice", "base_n", "base_f", "base_q", "seen_ok", "seen_hit", "halo", "rate", "cut"
    )
    joined = rows.join(carried, ["source", "_slice"])
    position = F.col("base_n") + F.col("pos")
    number = F.col("base_q") + F.col("q")
    last_ok = F.coalesce(F.col("base_n") + F.col("ok_pos"), "seen_ok")
    last_hit = F.coalesce(F.col("base_q") + F.col("hit_q"), "seen_hit")
    old_hit = F.coalesce(F.col("base_q") + F.col("old_hit_q"), "seen_hit")
    held = F.least("e", F.lit(entries))
    borrowed = F.when(
        held < entries,
        _last_entries(F.col("halo"), F.greatest(F.lit(entries) - held, F.lit(1)).cast("int")),
    ).otherwise(F.array().cast("array<double>"))
    total = F.aggregate(borrowed, F.lit(0.0), lambda acc, v: acc + v) + F.col("_sum")
    fps = F.when(F.col("e") > 0, total / (held + F.size(borrowed))).otherwise(F.col("rate"))
    gap = number - 1 - old_hit
    empty = F.when(F.col("inferred"), number - last_hit)
    return joined.where(F.col("cut").isNull() | (position < F.col("cut"))).select(
        "source",
        "read_idx",
        "ok",
        "dt_s",
        "n_dets",
        F.when(F.col("ok"), F.col("base_f") + F.col("f")).alias("frame_number"),
        (position - last_ok).alias("fail_streak"),
        F.when(F.col("ok"), fps).alias("fps"),
        empty.alias("empty_streak"),
        ((empty > 0) & (empty % streak == 0)).alias("alert"),
        F.when(F.col("hit") & (gap >= streak), gap).alias("resumed_after"),
    )


def surviving_reads(frames, cutoff=FAILED_READS, **more):
    """Reads before `cutoff` failed reads in a row end their source."""
    return frame_log(frames, cutoff=cutoff, **more).select(
        "source", "read_idx", "ok", "fail_streak"
    )


def number_frames(frames, cutoff=FAILED_READS, **more):
    """Good reads with their frame number, from 1 per source."""
    return (
        frame_log(frames, cutoff=cutoff, **more)
        .where("ok")
        .select("source", "read_idx", "frame_number", "dt_s", "n_dets")
    )


def rolling_rate(frames, cutoff=FAILED_READS, **more):
    """Frames per second shown at each good read."""
    return (
        frame_log(frames, cutoff=cutoff, **more)
        .where("ok")
        .select("source", "read_idx", "frame_number", "fps")
    )


def streak_alerts(frames, streak=EMPTY_FRAMES, cutoff=FAILED_READS, **more):
    """Frames that report a long run of empty frames, or its end."""
    log = frame_log(frames, cutoff=cutoff, streak=streak, **more)
    return log.where("alert or resumed_after is not null").select(
        "source",
        "read_idx",
        "frame_number",
        F.when(F.col("alert"), "empty").otherwise("resumed").alias("kind"),
        F.coalesce("resumed_after", "empty_streak").alias("frames"),
    )


def every_nth(numbered, n):
    """Frames on which detection runs."""
    require_every(n)
    return numbered.where((F.col("frame_number") - 1) % n == 0)


def with_infer_frame(numbered, n):
    """Adds the frame whose detections each frame shows."""
    number = F.col("frame_number")
    return numbered.withColumn("infer_frame", number - (number - 1) % n)


def carry_detections(numbered, dets, n):
    """Show on each frame the detections of the last frame that had detection run.

    `dets` has source, frame_number and its own columns. Frames without any are
    kept with nulls.
    """
    shown = with_infer_frame(numbered, n)
    source = dets.withColumnRenamed("frame_number", "infer_frame")
    return shown.join(source, ["source", "infer_frame"], "left")


def detections_per_frame(numbered, dets, n=1):
    """Detections shown on each frame, zeros included.

    `dets` are rows of source, frame_number; they are counted before the join.
    """
    counts = dets.groupBy("source", F.col("frame_number").alias("infer_frame")).agg(
        F.count("*").alias("shown")
    )
    return (
        with_infer_frame(numbered, n)
        .join(counts, ["source", "infer_frame"], "left")
        .select("source", "frame_number", F.coalesce("shown", F.lit(0)).alias("shown"))
    )


def settled_frame(frames, k=SETTLE_READS):
    """The k-th read of each source; (good ones, sources where it failed).

    The row-number limit is applied before the shuffle, so a long log sends at
    most k rows per task.
    """
    first = Window.partitionBy("source").orderBy("read_idx")
    picked = (
        frames.withColumn("_n", F.row_number().over(first))
        .where(F.col("_n") <= k)
        .where(F.col("_n") == k)
        .drop("_n")
    )
    ok = F.coalesce(F.col("ok"), F.lit(False))
    return picked.where(ok), picked.where(~ok)


def frames_processed(frames, cutoff=FAILED_READS, **more):
    """Good reads per source before its end."""
    return (
        surviving_reads(frames, cutoff, **more)
        .groupBy("source")
        .agg(F.count_if("ok").alias("frames"))
    )
