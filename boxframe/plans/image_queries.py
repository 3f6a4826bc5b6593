"""Queries over images (small rasters made from the embeddings) and streams."""

import uuid

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import detect as dt
from ..operators import raster
from ..operators.classes import vocabulary
from ..operators.groups import shared_folder
from ..schema import ClusterParams
from ..sources.frames import stream_frames, stream_lines
from ..streaming import live, tails
from .box_queries import MERGED_COLUMNS, merge_sql
from .fixtures import sql_over, table, view
from .frame_queries import ALERTS, CUTOFF, EVERY, LOG, RATES, STREAK
from .registry import query

# A vector of 64 numbers as an 8 by 8 raster.
SIDE = 8
LEVEL = "cast(least(255, greatest(0, floor(cast({e} as double) * 512) + 128)) as int)"


def images(spark, sf):
    """Rasters made from the vectors, as image rows: three equal channels per pixel."""
    level = F.expr("transform(embedding, e -> " + LEVEL.format(e="e") + ")")
    hexed = F.transform(level, lambda v: F.repeat(F.lpad(F.hex(v), 2, "0"), F.lit(3)))
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("image_id"),
        F.lit(SIDE).alias("height"),
        F.lit(SIDE).alias("width"),
        F.lit(3).alias("nChannels"),
        F.unhex(F.array_join(hexed, "")).alias("data"),
    )


PIXELS = f"""with recursive px as (select vec_id as id, cast(mod(p, {SIDE}) as int) as x, cast(p // {SIDE} as int) as y,
  cast(least(255, greatest(0, floor(cast(e as double) * 512) + 128)) as int) as v
  from (select vec_id, unnest(embedding) as e, generate_subscripts(embedding, 1) - 1 as p from embeddings))"""


def bright_spots():
    """A stand-in detector: every pixel above 200 is a box of one pixel."""

    def score(frame):
        y, x = np.nonzero(frame[:, :, 0] > 200)
        v = frame[y, x, 0]
        return np.column_stack([x, y, x + 1, y + 1, v / 256, v % 3])

    return score


SPOTS = """, spots as (select id as image_id, cast(row_number() over (partition by id order by y, x) - 1 as int) as det_idx, x::double as x1, y::double as y1,
  x + 1.0e0 as x2, y + 1.0e0 as y2, v / 256.0e0 as confidence, cast(v % 3 as int) as class_id from px where v > 200)"""


@query(
    f"""{PIXELS} {SPOTS} select *, case class_id when 0 then 'ecoli' when 1 then 'ecoli_cluster' else 'cls_' || cast(class_id as varchar) end as class_name
    from (select image_id, cast(row_number() over (partition by image_id order by det_idx) - 1 as int) as det_idx, x1, y1, x2, y2, confidence, class_id
      from spots where confidence >= 0.8e0)"""
)
def scored_images(spark, sf):
    classes = vocabulary(spark, ["ecoli", "ecoli_cluster"])
    return dt.detect(images(spark, sf), bright_spots, 0.8, classes)[0].select(
        "image_id", "det_idx", "x1", "y1", "x2", "y2", "confidence", "class_id", "class_name"
    )


PASSED = """, passed as (select image_id, cast(row_number() over (partition by image_id order by det_idx) - 1 as int) as det_idx,
  x1, y1, x2, y2, confidence, class_id from spots where confidence >= 0.8e0)"""


@query(
    PIXELS
    + SPOTS
    + PASSED
    + merge_sql("passed", "class_id = 0", 1, 0.02, 2, side=SIDE)
    + f" select {MERGED_COLUMNS} from merged"
)
def predicted_images(spark, sf):
    """Scoring, then the configured merge."""
    merge = ClusterParams(enabled=True, margin=0.02, min_size=2)
    out = dt.predict(images(spark, sf), bright_spots, 0.8, ["ecoli", "ecoli_cluster"], merge)
    return out[0].drop("class_name")


@query(
    """select vec_id as image_id, height, nChannels from (select vec_id, case when mod(vec_id, 7) = 0 then -1 else 8 end as height,
      case when mod(vec_id, 5) = 0 then 1 else 3 end as nChannels from embeddings) where height > 0 and nChannels = 3"""
)
def usable_frames(spark, sf):
    key = F.col("image_id")
    mixed = images(spark, sf).withColumns(
        {
            "height": F.when(key % 7 == 0, -1).otherwise(F.col("height")),
            "nChannels": F.when(key % 5 == 0, 1).otherwise(F.col("nChannels")),
        }
    )
    return dt.usable_frames(mixed)[0].select("image_id", "height", "nChannels")


@query(
    """select case when mod(vec_id, 7) = 0 then 'undecodable' else 'ok' end as status, count(*) as files from embeddings group by 1"""
)
def audit_totals(spark, sf):
    broken = images(spark, sf).withColumn(
        "height", F.when(F.col("image_id") % 7 == 0, -1).otherwise(F.col("height"))
    )
    return raster.audit_totals(raster.audit_images(broken))


@query(
    """select page_id, ['png', 'jpeg', 'gif', 'bmp', 'unknown'][mod(page_id, 5) + 1] as kind from pages"""
)
def file_kinds(spark, sf):
    heads = F.array(*[F.lit(h) for h in ("89504E470D0A1A0A", "FFD8FF", "47494638", "424D", "00")])
    head = F.unhex(F.get(heads, F.col("page_id") % 5))
    content = F.concat(head, F.col("html").cast("binary"))
    return table(spark, sf, "pages").select("page_id", raster.magic_kind(content).alias("kind"))


TILES = 2
CLIP = 3.0
EQUALISED = f""", placed as (select *, x * {TILES} // {SIDE} as tx, y * {TILES} // {SIDE} as ty from px),
  tile as (select id, tx, ty, list(v) as l, count(*) as pixels from placed group by all),
  hist as (select *, [len(list_filter(l, lambda a: a = v)) for v in range(256)] as h,
    greatest(floor({CLIP}e0 * pixels / 256), 1) as top from tile),
  clipped as (select id, tx, ty, pixels, [least(n, top) for n in h] as c,
    list_sum([greatest(n - top, 0) for n in h]) as excess from hist),
  even as (select *, floor(excess / 256) as share, excess - floor(excess / 256) * 256 as rest from clipped),
  spread as (select *, greatest(floor(256 / greatest(rest, 1)), 1) as step from even),
  levels as (select id, tx, ty, pixels, [c[v + 1] + share + case when v % step = 0 and floor(v / step) < rest
      then 1 else 0 end for v in range(256)] as n from spread),
  tables as (select id, tx, ty, [least(floor(list_sum(n[1:v + 1]) * 255.0e0 / pixels + 0.5e0), 255)
      for v in range(256)] as o from levels),
  grid as (select id, list(o order by ty, tx) as g from tables group by id),
  spot as (select *, (x + 0.5e0) * {TILES} / {SIDE} - 0.5e0 as fx, (y + 0.5e0) * {TILES} / {SIDE} - 0.5e0 as fy from px),
  near as (select *, fx - floor(fx) as ax, fy - floor(fy) as ay, cast(greatest(floor(fx), 0) as int) as l,
    cast(least(floor(fx) + 1, {TILES} - 1) as int) as r, cast(greatest(floor(fy), 0) as int) as t,
    cast(least(floor(fy) + 1, {TILES} - 1) as int) as b from spot)
  select id, x, y, v, cast(floor((g[t * {TILES} + l + 1][v + 1] * (1 - ax) + g[t * {TILES} + r + 1][v + 1] * ax) * (1 - ay)
    + (g[b * {TILES} + l + 1][v + 1] * (1 - ax) + g[b * {TILES} + r + 1][v + 1] * ax) * ay + 0.5e0) as int) as out
  from near join grid using (id)"""


def _levels(data):
    """The bytes of a column as an array of numbers."""
    hexed = F.regexp_extract_all(F.hex(data), F.lit("(..)"), 1)
    return F.transform(hexed, lambda h: F.conv(h, 16, 10).cast("int"))


@query(f"{PIXELS} {EQUALISED}")
def equalised_pixels(spark, sf):
    grey = images(spark, sf).withColumns(
        {
            "nChannels": F.lit(1),
            "before": F.filter(_levels(F.col("data")), lambda v, i: i % 3 == 0),
        }
    )
    grey = grey.withColumn("data", F.unhex(F.array_join(F.transform("before", lambda v: F.lpad(F.hex(v), 2, "0")), "")))
    done = raster.equalize_images(grey, TILES, CLIP)
    both = F.arrays_zip(F.col("before").alias("v"), _levels(F.col("data")).alias("out"))
    rows = done.select(F.col("image_id").alias("id"), F.posexplode(both).alias("p", "b"))
    return rows.select(
        "id",
        (F.col("p") % SIDE).alias("x"),
        F.floor(F.col("p") / SIDE).cast("int").alias("y"),
        F.col("b.v").alias("v"),
        F.col("b.out").alias("out"),
    )


@query()
def equalised_colours(spark, sf):
    """Colour images in and out; the channels differ."""
    turned = F.transform(_levels(F.col("data")), lambda v, i: F.pmod(v * (1 + 6 * (i % 3)), F.lit(256)))
    hexed = F.transform(turned, lambda v: F.lpad(F.hex(v), 2, "0"))
    colour = images(spark, sf).withColumn("data", F.unhex(F.array_join(hexed, "")))
    done = raster.equalize_images(colour, TILES, CLIP)
    return done.select("image_id", F.hex("data").alias("data"))


# Streams: the view is written in parts to the shared folder and followed after
# each part, so the job goes through several micro-batches.
PARTS = 3


def _followed_log(spark, sf):
    root = f"{shared_folder(spark)}/frames-{uuid.uuid4().hex}"
    reads = view(spark, sf, "frames")
    last = reads.agg(F.max("read_idx")).first()[0]
    for part in range(PARTS):
        bounds = F.col("read_idx").between(last * part // PARTS + 1, last * (part + 1) // PARTS)
        reads.where(bounds).write.mode("append").parquet(f"{root}/in")
        stream = stream_frames(spark, f"{root}/in", reads.schema)
        job = live.follow_frames(
            stream, f"{root}/out", f"{root}/checkpoint", infer_every=EVERY, streak=STREAK, cutoff=CUTOFF
        )
        job.awaitTermination()
    return live.read_results(spark, f"{root}/out")


@query(
    sql_over(
        "frames",
        LOG + f", rated as ({RATES}) select source, read_idx, frame_number, fps, frame_number - mod(frame_number - 1, {EVERY}) as infer_frame from rated",
    )
)
def streamed_rates(spark, sf):
    return _followed_log(spark, sf).where("ok").select(
        "source", "read_idx", "frame_number", "fps", "infer_frame"
    )


@query(sql_over("frames", LOG + ALERTS))
def streamed_alerts(spark, sf):
    log = _followed_log(spark, sf).where("alert or resumed_after is not null")
    return log.select(
        "source", "read_idx", "frame_number",
        F.when(F.col("alert"), "empty").otherwise("resumed").alias("kind"),
        F.coalesce("resumed_after", "empty_streak").alias("frames"),
    )


@query(sql_over("frames", f"{LOG} select source, read_idx, ok, fail_streak from alive"))
def streamed_reads(spark, sf):
    return _followed_log(spark, sf).select("source", "read_idx", "ok", "fail_streak")


@query(f"{PIXELS} {SPOTS} select count(*) as n, cast(sum(x1 + y1 * 8) as bigint) as place from spots where confidence >= 0.8e0 and mod(image_id // 5, 2) = 0")
def streamed_detections(spark, sf):
    """Detection on every second frame of five sources; nothing is merged."""
    root = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    reads = images(spark, sf).select(
        (F.col("image_id") % 5).alias("source"),
        F.col("image_id").alias("read_idx"),
        F.lit(True).alias("ok"),
        F.lit(0.03125).cast("double").alias("dt_s"),
        F.lit(1).alias("n_dets"),
        "height", "width", "nChannels", "data",
    )
    reads.write.parquet(f"{root}/in")
    stream = stream_frames(spark, f"{root}/in", reads.schema)
    job = live.follow_detections(
        stream, bright_spots, ["ecoli"], ClusterParams(), f"{root}/out", f"{root}/checkpoint",
        conf=0.8, infer_every=2,
    )
    job.awaitTermination()
    found = live.read_results(spark, f"{root}/out", "detections")
    return found.agg(
        F.count("*").alias("n"), F.sum(F.col("x1") + F.col("y1") * 8).cast("bigint").alias("place")
    )


@query(
    r"""with l as (select role || ' ' || regexp_replace(text, '[\r\n]+', ' ', 'g') as line from conversations)
    select line, count(*) as n from l group by line"""
)
def streamed_log_lines(spark, sf):
    root = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    plain = F.regexp_replace("text", r"[\r\n]+", " ")
    coloured = F.concat(F.lit("\x1b[1;32m"), F.col("role"), F.lit("\x1b[0m "), plain)
    table(spark, sf, "conversations").select(coloured.alias("value")).write.text(f"{root}/in")
    live.follow_log(
        stream_lines(spark, f"{root}/in"), f"{root}/out", f"{root}/checkpoint"
    ).awaitTermination()
    lines = spark.read.parquet(f"{root}/out")
    return lines.groupBy("line").agg(F.count("*").alias("n"))


@query(
    r"""with l as (select mod(conv_id, 40) as run, conv_id * 100 + turn as seq, role || ' ' || text as line from conversations),
      n as (select *, row_number() over (partition by run order by seq desc) as n from l)
    select run, seq, line from n where n <= 25"""
)
def streamed_log_tails(spark, sf):
    """The last 25 lines of each run, followed over several batches."""
    root = f"{shared_folder(spark)}/tails-{uuid.uuid4().hex}"
    lines = table(spark, sf, "conversations").select(
        (F.col("conv_id") % 40).alias("run"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("seq"),
        F.concat(F.lit("\x1b[1;32m"), F.col("role"), F.lit("\x1b[0m "), F.col("text")).alias("line"),
    )
    part = F.ntile(3).over(Window.orderBy("low"))
    cuts = lines.groupBy(F.floor(F.col("seq") / 5000).alias("low")).count().select("low", part.alias("part"))
    dealt = lines.withColumn("low", F.floor(F.col("seq") / 5000)).join(cuts, "low").drop("low")
    for n in (1, 2, 3):
        dealt.where(F.col("part") == n).drop("part").coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    tails.follow_tails(stream, f"{root}/out", f"{root}/checkpoint", shown=25, kept=60).awaitTermination()
    return tails.read_tails(spark, f"{root}/out")
