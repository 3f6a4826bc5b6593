"""Queries over frame logs, run logs and run events."""

from pyspark.sql import functions as F

from ..functions import text
from ..operators import frames as fr
from ..operators import runs
from ..operators.asof import asof_join
from .fixtures import sql_over, table, view
from .registry import query

# The view has short runs of failures and empty frames; thresholds to match.
CUTOFF = 6
STREAK = 10
EVERY = 4

LOG = f""", placed as (
  select *, row_number() over w as pos, sum(case when ok then 1 else 0 end) over w as good from frames
    window w as (partition by source order by read_idx)),
  failing as (select *, pos - coalesce(max(case when ok then pos end) over (partition by source order by read_idx), 0) as fail_streak from placed),
  ends as (select source, min(pos) as cut from failing where fail_streak >= {CUTOFF} group by source),
  alive as materialized (select f.* from failing f left join ends e using (source) where cut is null or pos < cut),
  good_frames as (select source, read_idx, cast(good as bigint) as frame_number, dt_s, n_dets from alive where ok),
  entries as (select source, frame_number, avg(1 / dt_s) over (partition by source order by frame_number rows between 29 preceding and current row) as rate
    from good_frames where dt_s > 0),
  hits as (select *, coalesce(max(case when n_dets > 0 then frame_number end) over (partition by source order by frame_number), 0) as last_hit,
    coalesce(max(case when n_dets > 0 then frame_number end) over (partition by source order by frame_number rows between unbounded preceding and 1 preceding), 0) as old_hit
    from good_frames)"""


def frames(spark, sf):
    return view(spark, sf, "frames")


@query(sql_over("frames", f"{LOG} select source, read_idx, ok, fail_streak from alive"))
def surviving_reads(spark, sf):
    return fr.surviving_reads(frames(spark, sf), CUTOFF)


@query(sql_over("frames", f"{LOG} select source, count(*) filter (ok) as frames from alive group by source"))
def frames_processed(spark, sf):
    return fr.frames_processed(frames(spark, sf), CUTOFF)


@query(sql_over("frames", f"{LOG} select * from good_frames"))
def numbered_frames(spark, sf):
    return fr.number_frames(frames(spark, sf), CUTOFF)


RATES = """ select source, read_idx, frame_number, coalesce(last_value(rate ignore nulls) over (
  partition by source order by frame_number rows between unbounded preceding and current row), 0) as fps
  from good_frames left join entries using (source, frame_number)"""


@query(sql_over("frames", LOG + RATES))
def rolling_rate(spark, sf):
    return fr.rolling_rate(frames(spark, sf), CUTOFF)


@query(sql_over("frames", LOG + RATES))
def rolling_rate_small_slices(spark, sf):
    """The same with slices so short that each source has many."""
    return fr.rolling_rate(frames(spark, sf), CUTOFF, slice_rows=64)


ALERTS = f""" select source, read_idx, frame_number, 'empty' as kind, frame_number - last_hit as frames from hits
  where frame_number - last_hit > 0 and mod(frame_number - last_hit, {STREAK}) = 0
  union all select source, read_idx, frame_number, 'resumed', frame_number - 1 - old_hit from hits
  where n_dets > 0 and frame_number - 1 - old_hit >= {STREAK}"""


@query(sql_over("frames", LOG + ALERTS))
def streak_alerts(spark, sf):
    return fr.streak_alerts(frames(spark, sf), STREAK, CUTOFF)


@query(sql_over("frames", f"{LOG} select * from good_frames where mod(frame_number - 1, {EVERY}) = 0"))
def every_fourth_frame(spark, sf):
    return fr.every_nth(fr.number_frames(frames(spark, sf), CUTOFF), EVERY)


def _dets(numbered):
    """One row per detection of the frames that have detection run."""
    return (
        fr.every_nth(numbered, EVERY)
        .where("n_dets > 0")
        .select("source", "frame_number", F.explode(F.sequence(F.lit(1), "n_dets")).alias("det_no"))
    )


CARRIED = f""", shown as (select *, frame_number - mod(frame_number - 1, {EVERY}) as infer_frame from good_frames),
  dets as (select source, frame_number as infer_frame, unnest(range(1, n_dets + 1)) as det_no from good_frames
    where mod(frame_number - 1, {EVERY}) = 0 and n_dets > 0)"""


@query(
    sql_over(
        "frames",
        f"{LOG} {CARRIED} select source, frame_number, infer_frame, cast(det_no as int) as det_no from shown left join dets using (source, infer_frame)",
    )
)
def carried_detections(spark, sf):
    numbered = fr.number_frames(frames(spark, sf), CUTOFF)
    return fr.carry_detections(numbered, _dets(numbered), EVERY).select(
        "source", "frame_number", "infer_frame", "det_no"
    )


@query(
    sql_over(
        "frames",
        f"{LOG} {CARRIED} select source, frame_number, count(det_no) as shown from shown left join dets using (source, infer_frame) group by source, frame_number",
    )
)
def detections_per_frame(spark, sf):
    numbered = fr.number_frames(frames(spark, sf), CUTOFF)
    return fr.detections_per_frame(numbered, _dets(numbered), EVERY)


SETTLED = ", picked as (select *, row_number() over (partition by source order by read_idx) as n from cams)"
CAMS = """, cams as (select source * 1000 + mod(read_idx, 40) as source, read_idx, ok, dt_s, n_dets from frames)"""


def _cams(spark, sf):
    return frames(spark, sf).withColumn("source", F.col("source") * 1000 + F.col("read_idx") % 40)


@query(sql_over("frames", f"{CAMS} {SETTLED} select source, read_idx, ok, dt_s, n_dets from picked where n = 4 and ok"))
def settled_frames(spark, sf):
    return fr.settled_frame(_cams(spark, sf))[0]


@query(sql_over("frames", f"{CAMS} {SETTLED} select source, read_idx, ok, dt_s, n_dets from picked where n = 4 and not ok"))
def unsettled_sources(spark, sf):
    return fr.settled_frame(_cams(spark, sf))[1]


@query(
    """select c_custkey, case when regexp_full_match(s, '[0-9]+') then 'device' else 'path' end as kind from (
      select c_custkey, case mod(c_custkey, 4) when 0 then cast(c_custkey as varchar) when 1 then '/dev/video' || cast(c_custkey as varchar)
      when 2 then 'rtsp://cam/' || cast(c_custkey as varchar) else cast(c_custkey as varchar) || '.mp4' end as s from customer)"""
)
def source_kinds(spark, sf):
    named = table(spark, sf, "customer").selectExpr(
        "c_custkey",
        """case c_custkey % 4 when 0 then cast(c_custkey as string) when 1 then concat('/dev/video', c_custkey)
        when 2 then concat('rtsp://cam/', c_custkey) else concat(c_custkey, '.mp4') end as s""",
    )
    return named.select("c_custkey", text.source_kind("s").alias("kind"))


@query(
    """select o_orderkey, case when s >= 3600 then cast(s // 3600 as varchar) || 'h ' || cast((s % 3600) // 60 as varchar) || 'm'
      when s >= 60 then cast(s // 60 as varchar) || 'm ' || cast(s % 60 as varchar) || 's' else cast(s as varchar) || 's' end as elapsed
      from (select o_orderkey, mod(o_orderkey * 977, 10000) as s from orders)"""
)
def elapsed_times(spark, sf):
    seconds = F.col("o_orderkey") * 977 % 10000
    return table(spark, sf, "orders").select(
        "o_orderkey", text.elapsed_text(seconds).alias("elapsed")
    )


CLEANED = r""", cleaned as (select run, seq, regexp_replace(regexp_replace(line, '\x1b\[[0-9;?]*[A-Za-z]', '', 'g'), '[\r\n]+$', '') as line from log_lines)"""


@query(sql_over("log_lines", f"{CLEANED} select * from cleaned"))
def clean_log_lines(spark, sf):
    return runs.clean_log(view(spark, sf, "log_lines"))


@query(
    sql_over(
        "log_lines",
        f"""{CLEANED} select run, seq, line from (select *, row_number() over (partition by run order by seq desc) as n from cleaned) where n <= 3""",
    )
)
def log_tail(spark, sf):
    return runs.clean_log(runs.log_tail(view(spark, sf, "log_lines"), 3))


STATES = """, starts as (select run, min(seq) filter (kind = 'start') as started from run_events group by run),
  ends as (select e.run, min(seq) filter (kind = 'exit') as finished, arg_min(return_code, seq) filter (kind = 'exit') as return_code,
    min(seq) filter (kind = 'kill') as killed from run_events e join starts s on e.run = s.run and seq > started
    where kind in ('exit', 'kill') group by e.run),
  states as (select s.run, case when started is null then 'idle' when killed is not null and (finished is null or killed < finished) then 'killed'
    when finished is null then 'running' when return_code = 0 then 'completed' else 'failed' end as state,
    started, finished, return_code from starts s left join ends e using (run))"""


@query(sql_over("run_events", f"{STATES} select * from states"))
def run_states(spark, sf):
    return runs.run_states(view(spark, sf, "run_events"))


@query(
    sql_over(
        "run_events log_lines",
        CLEANED
        + STATES
        + """, tails as (select run, string_agg(line, chr(10) order by seq) as log_text from (
            select *, row_number() over (partition by run order by seq desc) as n from cleaned) where n <= 5 group by run)
        select s.*, coalesce(log_text, '') as log_text from states s left join tails using (run)""",
    )
)
def run_status(spark, sf):
    status = runs.run_status(view(spark, sf, "run_events"), view(spark, sf, "log_lines"), 5)
    return status.withColumn("log_text", F.array_join("log_lines", "\n")).drop("log_lines")


@query(
    """with spans as (select o_orderkey as run, epoch_ms(o_orderdate) // 1000 + mod(o_orderkey * 7919, 86400) as started,
        case when mod(o_orderkey, 997) = 0 then null else epoch_ms(o_orderdate) // 1000 + mod(o_orderkey * 7919, 86400) + mod(o_orderkey * 31, 9000) end as finished from orders)
      select run, started, finished from (select *, max(coalesce(finished, 9223372036854775807)) over (order by started, run
        rows between unbounded preceding and 1 preceding) as latest from spans) where latest > started"""
)
def overlapping_runs(spark, sf):
    second = F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("o_orderdate"))
    key = F.col("o_orderkey")
    started = second + key * 7919 % 86400
    spans = table(spark, sf, "orders").select(
        key.alias("run"),
        started.alias("started"),
        F.when(key % 997 != 0, started + key * 31 % 9000).alias("finished"),
    )
    return runs.overlapping_runs(spans, slice_width=30 * 86400)


# Detections that come some reads after their frame, at uneven times.
LATE_SQL = """select source, read_idx + mod(read_idx * 7, 11) as due, read_idx as det_id, n_dets as shown
  from frames where n_dets > 0"""


def _late(spark, sf):
    return view(spark, sf, "frames").where("n_dets > 0").selectExpr(
        "source", "read_idx + (read_idx * 7) % 11 as due", "read_idx as det_id", "n_dets as shown"
    )


@query(
    sql_over(
        "frames",
        f""", late as ({LATE_SQL}), last as (select source, due, max(det_id) as det_id, arg_max(shown, det_id) as shown from late group by source, due)
        select f.source, f.read_idx, l.det_id, l.shown from frames f asof left join last l on f.source = l.source and f.read_idx >= l.due""",
    )
)
def asof_detections(spark, sf):
    """For each read the latest detections known by then."""
    reads = view(spark, sf, "frames").select("source", "read_idx", F.col("read_idx").alias("due"))
    joined = asof_join(reads, _late(spark, sf), ["source"], "due", "det_id")
    return joined.select("source", "read_idx", "match.det_id", "match.shown")
