"""Queries over detections: geometry, merging, suppression, counts, labels."""

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import text
from ..operators import classes as cl
from ..operators import cluster, degree, detect
from ..operators.groups import durable, skew_join
from ..operators.suppress import suppress
from .fixtures import SIZE, sql_over, table, view
from .registry import query

TARGET = 1


def boxes(spark, sf):
    return view(spark, sf, "boxes")


def named_boxes(spark, sf):
    """Boxes with names and more class ids than the view has."""
    return boxes(spark, sf).select(
        "image_id",
        "det_idx",
        *cluster.CORNERS,
        "confidence",
        F.when(F.col("class_id") == 0, 2)
        .otherwise(F.pmod(F.col("det_idx") * 7 + F.col("image_id"), F.lit(11)))
        .cast("int")
        .alias("class_id"),
        F.when(F.col("class_id") == 0, "ecoli").otherwise("other").alias("class_name"),
    )


NAMED_SQL = """, named as (
  select image_id, det_idx, x1, y1, x2, y2, confidence,
    cast(case when class_id = 0 then 2 else mod(det_idx * 7 + image_id, 11) end as int) as class_id,
    case when class_id = 0 then 'ecoli' else 'other' end as class_name
  from boxes)"""


def merge_sql(dets, is_source, target, margin, min_size=3, side=1280):
    """The merge of `dets` as SQL, up to a relation `merged`."""
    grow = f"({margin}e0 * {side})"
    return f""", d as materialized (select *, not ({is_source}) as is_other from {dets}),
  src as materialized (
    select image_id, det_idx, x1 - {grow} as a1, y1 - {grow} as b1, x2 + {grow} as a2, y2 + {grow} as b2
    from d where not is_other),
  act as (select image_id, count(*) filter (not is_other) >= {min_size} and {min_size} >= 2 as active
    from d group by image_id),
  edge as materialized (
    select p.image_id, p.det_idx as a, q.det_idx as b from src p join src q
    on p.image_id = q.image_id and p.det_idx <> q.det_idx
    and p.a1 <= q.a2 and q.a1 <= p.a2 and p.b1 <= q.b2 and q.b1 <= p.b2),
  reach as (
    select image_id, det_idx as a, det_idx as b from src
    union
    select r.image_id, r.a, e.b from reach r join edge e on r.image_id = e.image_id and r.b = e.a),
  comps as (select image_id, a as det_idx, min(b) as comp from reach group by image_id, a),
  sized as (select *, count(*) over (partition by image_id, comp) as size from comps),
  units as (
    select d.*, act.active, s.comp, coalesce(act.active and s.size >= {min_size}, false) as is_merged
    from d join act using (image_id) left join sized s
      on d.image_id = s.image_id and d.det_idx = s.det_idx),
  folded as (
    select image_id, active, is_other, is_merged, comp,
      min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2, avg(confidence) as confidence,
      case when is_merged then {target} else min(class_id) end as class_id,
      cast(count(*) as int) as members, min(det_idx) as first_det
    from units
    group by image_id, active, is_other, is_merged, comp,
      case when is_merged then comp else det_idx end),
  merged as materialized (
    select *, cast(row_number() over (partition by image_id order by
      case when active then -confidence end nulls first,
      case when active then is_other end nulls first,
      case when active then comp end nulls first, first_det) - 1 as int) as out_pos
    from folded)"""


MERGED_COLUMNS = (
    "image_id, out_pos, x1, y1, x2, y2, confidence, cast(class_id as int) as class_id, members, first_det"
)
MERGE = merge_sql("boxes", "class_id = 0", TARGET, 0.01)


def merged(spark, sf):
    return cluster.merge_clusters(
        boxes(spark, sf), SIZE, target_class_id=TARGET, target_class_name="ecoli_cluster"
    )


@query(sql_over("boxes", f"{MERGE} select {MERGED_COLUMNS} from merged"))
def cluster_merge(spark, sf):
    return merged(spark, sf).drop("class_name")


# Images with more boxes than this are large in the queries named `_cells`.
FEW = 60


@query(sql_over("boxes", f"{MERGE} select {MERGED_COLUMNS} from merged"))
def cluster_merge_cells(spark, sf):
    """The same merge, nearly all of it by cells."""
    out = cluster.merge_clusters(
        boxes(spark, sf), SIZE, target_class_id=TARGET, target_class_name="ecoli_cluster", limit=FEW
    )
    return out.drop("class_name")


# Boxes of which some have no class, and sizes that some images lack.
GAPS = """, gaps as (select image_id, det_idx, x1, y1, x2, y2, confidence,
    case when mod(det_idx, 6) <> 5 then class_id end as class_id from boxes)"""


def _gaps(spark, sf):
    return boxes(spark, sf).withColumn(
        "class_id", F.when(F.col("det_idx") % 6 != 5, F.col("class_id"))
    )


def _merged_gaps(spark, sf, **more):
    rows = _gaps(spark, sf)
    sizes = (
        rows.where("image_id % 4 <> 3")
        .groupBy("image_id")
        .agg(F.lit(SIZE[0]).alias("width"), F.lit(SIZE[1]).alias("height"))
    )
    out = cluster.merge_clusters(rows, sizes, target_class_id=TARGET, **more)
    return out.drop("class_name")


MERGED_GAPS = sql_over(
    "boxes",
    GAPS
    + merge_sql("gaps", "coalesce(class_id = 0, false)", TARGET, 0.01).replace(
        "count(*) filter (not is_other) >= 3 and 3 >= 2",
        "count(*) filter (not is_other) >= 3 and mod(image_id, 4) <> 3",
    )
    + f" select {MERGED_COLUMNS} from merged",
)


@query(MERGED_GAPS)
def cluster_merge_gaps(spark, sf):
    """Boxes without a class and images without a size pass through."""
    return _merged_gaps(spark, sf)


@query(MERGED_GAPS)
def cluster_merge_gaps_cells(spark, sf):
    return _merged_gaps(spark, sf, limit=FEW)


@query(
    sql_over(
        "boxes",
        merge_sql("boxes", "class_id = 0", TARGET, 0.0, 5)
        + f" select {MERGED_COLUMNS} from merged where is_merged",
    )
)
def cluster_boxes(spark, sf):
    out = cluster.merge_clusters(boxes(spark, sf), SIZE, margin=0.0, min_size=5)
    return out.where("members >= 5").drop("class_name")


@query(
    sql_over("boxes", "select image_id, det_idx as out_pos, x1, y1, x2, y2, confidence, class_id, 1 as members, det_idx as first_det from boxes")
)
def cluster_merge_off(spark, sf):
    """Groups of one are not groups: the boxes come back in their order."""
    return cluster.merge_clusters(boxes(spark, sf), SIZE, min_size=1).drop("class_name")


def _grown_sources(spark, sf):
    grow = geo.margin_pixels(0.01, F.lit(SIZE[0]), F.lit(SIZE[1]))
    corners = geo.inflate(*cluster.CORNERS, grow)
    return (
        boxes(spark, sf)
        .where("class_id = 0")
        .select("image_id", "det_idx", *[c.alias(n) for n, c in zip(cluster.CORNERS, corners)])
    )


@query(
    sql_over("boxes", f"{MERGE} select image_id, det_idx, comp from comps")
)
def box_components(spark, sf):
    return cluster.box_components(_grown_sources(spark, sf))


@query(
    sql_over("boxes", f"{MERGE} select image_id, det_idx, comp from comps")
)
def box_components_cells(spark, sf):
    return cluster.box_components(_grown_sources(spark, sf), limit=FEW)


@query(
    sql_over(
        "boxes",
        f"{MERGE} select distinct image_id, a as det_idx from edge",
    )
)
def touching_boxes(spark, sf):
    """Boxes that meet another one; found from components, not from pairs."""
    comps = cluster.box_components(_grown_sources(spark, sf))
    size = comps.groupBy("image_id", "comp").agg(F.count("*").alias("n")).where("n > 1")
    return comps.join(size, ["image_id", "comp"]).select("image_id", "det_idx")


@query(
    sql_over(
        "boxes",
        """, g as (select image_id, det_idx, x1 - m as x1, y1 - m as y1, x2 + m as x2, y2 + m as y2
          from (select *, 1e-2 * greatest(1280, 720) as m from boxes where class_id = 0))
        select a.image_id, a.det_idx, count(b.det_idx) as degree from g a left join g b on a.image_id = b.image_id
          and a.det_idx <> b.det_idx and a.x1 <= b.x2 and b.x1 <= a.x2 and a.y1 <= b.y2 and b.y1 <= a.y2
        group by a.image_id, a.det_idx""",
    )
)
def touch_degrees(spark, sf):
    """How many boxes each box meets; counted, no pair is made."""
    return degree.touch_degrees(_grown_sources(spark, sf))


@query(
    sql_over(
        "boxes",
        """, g as (select *, 1e-2 * greatest(1280, 720) as m from boxes)
        select image_id, det_idx, m as margin_px, x1 - m as x1, y1 - m as y1, x2 + m as x2,
          y2 + m as y2, (x1 - m <= 640 and x2 + m >= 640 and y1 - m <= 360 and y2 + m >= 360)
          as covers_centre from g""",
    )
)
def inflated_boxes(spark, sf):
    grow = F.col("margin_px")
    corners = dict(zip(cluster.CORNERS, geo.inflate(*cluster.CORNERS, grow)))
    centre = [F.lit(640.0), F.lit(360.0)] * 2
    return (
        boxes(spark, sf)
        .withColumn("margin_px", geo.margin_pixels(0.01, F.lit(SIZE[0]), F.lit(SIZE[1])))
        .withColumns(corners)
        .select(
            "image_id",
            "det_idx",
            "margin_px",
            *cluster.CORNERS,
            geo.intersects(cluster.CORNERS, centre).alias("covers_centre"),
        )
    )


VIEWER_FOLD = """, firsts as (
    select n.image_id, n.class_id + 1 as t from named n join (
      select image_id, min(det_idx) as det_idx from named where class_name = 'ecoli' group by image_id)
      using (image_id, det_idx)),
  fold as (
    select image_id, -1 as i, t from firsts
    union all
    select f.image_id, f.i + 1, case when n.class_id > f.t then n.class_id + 1 else f.t end
    from fold f join named n on n.image_id = f.image_id and n.det_idx = f.i + 1),
  ids as (select image_id, cast(arg_max(t, i) as int) as target_id from fold group by image_id)"""


@query(sql_over("boxes", f"{NAMED_SQL} {VIEWER_FOLD} select image_id, target_id from ids"))
def viewer_class_ids(spark, sf):
    return cluster.next_class_id(named_boxes(spark, sf), "ecoli")


@query(
    sql_over(
        "boxes",
        NAMED_SQL
        + VIEWER_FOLD
        + merge_sql("named", "class_name = 'ecoli'", "-1", 0.02, 2)
        + """ select image_id, out_pos, x1, y1, x2, y2, confidence,
            cast(case when is_merged then target_id else class_id end as int) as class_id, members, first_det,
            case when is_merged then 'cluster' when is_other then 'other' else 'ecoli' end as class_name
            from merged left join ids using (image_id)""",
    )
)
def viewer_merge(spark, sf):
    return cluster.merge_by_name(
        named_boxes(spark, sf), SIZE, "ecoli", "cluster", margin=0.02, min_size=2
    )


def _iou_sql(a, b):
    w = f"greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0)"
    h = f"greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0)"
    one = f"({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1)"
    two = f"({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1)"
    return f"({w} * {h}) / ({one} + {two} - {w} * {h})"


def suppress_sql(keys, threshold):
    """Greedy suppression: boxes by rank, each step decides one box per group."""
    same = " and ".join(f"a.{k} = b.{k}" for k in keys)
    part = ", ".join(keys)
    steps = " and ".join(f"r.{k} = k.{k}" for k in keys)
    return f""", ranked as materialized (
    select *, row_number() over (partition by {part} order by confidence desc, det_idx) as rk from boxes),
  hits as materialized (
    select {', '.join('b.' + k for k in keys)}, b.rk, list(a.rk) as better
    from ranked a join ranked b on {same} and a.rk < b.rk and {_iou_sql('a', 'b')} > {threshold}e0
    group by {', '.join('b.' + k for k in keys)}, b.rk),
  todo as materialized (select r.*, h.better from ranked r left join hits h on
    {' and '.join(f'r.{k} = h.{k}' for k in keys)} and r.rk = h.rk),
  walk as (
    select {part}, 0::bigint as rk, []::bigint[] as kept from (select distinct {part} from ranked)
    union all
    select {', '.join('k.' + k for k in keys)}, r.rk, case when list_has_any(k.kept, coalesce(r.better, []::bigint[]))
      then k.kept else list_append(k.kept, r.rk) end
    from walk k join todo r on {steps} and r.rk = k.rk + 1),
  final as (select {part}, arg_max(kept, rk) as kept from walk group by {part})
  select r.image_id, r.det_idx, r.class_id, r.x1, r.y1, r.x2, r.y2, r.confidence
  from ranked r join final k on {steps} and list_contains(k.kept, r.rk)"""


@query(sql_over("boxes", suppress_sql(["image_id", "class_id"], 0.45)))
def suppressed_boxes(spark, sf):
    return suppress(boxes(spark, sf), 0.45)


@query(sql_over("boxes", suppress_sql(["image_id", "class_id"], 0.45)))
def suppressed_cells(spark, sf):
    """The same suppression, nearly all of it by tiles."""
    return suppress(boxes(spark, sf), 0.45, limit=FEW)


@query(sql_over("boxes", suppress_sql(["image_id"], 0.2)))
def suppressed_any_class(spark, sf):
    return suppress(boxes(spark, sf), 0.2, agnostic=True)


@query(sql_over("boxes", "select * from boxes where confidence >= 0.6e0"))
def confident_boxes(spark, sf):
    return detect.confident(boxes(spark, sf), 0.6)


@query(
    sql_over(
        "boxes",
        "select image_id, det_idx, case when class_id = 0 then 'source' else 'other' end as part from boxes",
    )
)
def class_partition(spark, sf):
    part = F.when(F.col("class_id") == 0, "source").otherwise("other")
    return boxes(spark, sf).select("image_id", "det_idx", part.alias("part"))


@query(
    sql_over(
        "boxes",
        f"""{MERGE} select image_id, count(*) filter (confidence >= 0.5e0 and is_merged) as clusters
        from merged group by image_id""",
    )
)
def cluster_counts(spark, sf):
    return detect.shown_clusters(merged(spark, sf), 0.5)


@query(
    sql_over(
        "boxes",
        f"""{MERGE} select image_id, r.n as raw, m.n as shown, r.listed from
        (select image_id, count(*) as n, count(*) filter (confidence >= 0.5e0) as listed from boxes group by 1) r
        join (select image_id, count(*) filter (confidence >= 0.5e0) as n from merged group by 1) m using (image_id)""",
    )
)
def detection_counts(spark, sf):
    raw = boxes(spark, sf)
    return detect.detection_counts(raw, merged(spark, sf), 0.5)


@query(
    sql_over(
        "boxes",
        f"""{MERGE} select image_id, out_pos, cast(class_id as int) as class_id,
        (x1 + (x2 - x1) / 2) / 1280 as cx, (y1 + (y2 - y1) / 2) / 720 as cy,
        (x2 - x1) / 1280 as w, (y2 - y1) / 720 as h from merged
        where confidence >= 0.5e0 and x2 > x1 and y2 > y1""",
    )
)
def pseudo_labels(spark, sf):
    return detect.pseudo_labels(boxes(spark, sf), SIZE, 0.5)


@query()
def nested_predictions(spark, sf):
    out = merged(spark, sf)
    images = (
        boxes(spark, sf)
        .groupBy("image_id")
        .agg(F.lit(SIZE[0]).alias("width"), F.lit(SIZE[1]).alias("height"))
        .withColumn("inference_ms", F.pmod("image_id", F.lit(40)).cast("double"))
    )
    return detect.nest_predictions(out, images)


@query(
    sql_over(
        "boxes classes",
        """select image_id, det_idx, b.class_id, coalesce(class_name, 'cls_' || cast(b.class_id as varchar)) as class_name
        from (select image_id, det_idx, cast(mod(det_idx, 8) as int) as class_id from boxes) b
        left join classes c on b.class_id = c.class_id""",
    )
)
def named_detections(spark, sf):
    rows = boxes(spark, sf).select(
        "image_id", "det_idx", (F.col("det_idx") % 8).cast("int").alias("class_id")
    )
    return cl.name_classes(rows, view(spark, sf, "classes")).select(
        "image_id", "det_idx", "class_id", "class_name"
    )


@query(
    sql_over(
        "boxes",
        """select image_id, det_idx,
        ['#00ff00', '#0080ff', '#ff0040', '#ffff00', '#ff00ff', '#00ffff', '#ffffff', '#ff0080'][mod(det_idx, 8) + 1] as colour,
        [0, 255, 0, 255, 255, 0, 255, 128][mod(det_idx, 8) + 1] as blue,
        'ecoli ' || printf('%.2f', confidence) as frame_label,
        'ecoli ' || cast(cast(floor(confidence * 100 + 0.5e0) as bigint) as varchar) || '%' as percent_label,
        cast(cast(floor(confidence * 1000 + 0.5e0) as bigint) // 10 as varchar) || '.' ||
          cast(cast(floor(confidence * 1000 + 0.5e0) as bigint) % 10 as varchar) || '%' as percent
        from boxes""",
    )
)
def box_captions(spark, sf):
    return boxes(spark, sf).select(
        "image_id",
        "det_idx",
        text.class_colour("det_idx").alias("colour"),
        F.get(text.class_colour_bgr("det_idx"), F.lit(0)).alias("blue"),
        text.frame_label(F.lit("ecoli"), "confidence").alias("frame_label"),
        text.percent_label(F.lit("ecoli"), "confidence").alias("percent_label"),
        text.percent_text("confidence").alias("percent"),
    )


SHIFTED = """, shifted as (
  select image_id, det_idx, x1, y1, x1 + (x2 - x1) * (mod(det_idx, 5) - 1) as x2, y2 from boxes)"""


@query(
    sql_over(
        "boxes",
        SHIFTED
        + """ select image_id, det_idx, (x1 + (x2 - x1) / 2) / 1280 as cx, (y1 + (y2 - y1) / 2) / 720 as cy,
        (x2 - x1) / 1280 as w, (y2 - y1) / 720 as h from shifted where x2 > x1""",
    )
)
def label_boxes(spark, sf):
    wide = (F.col("x2") - F.col("x1")) * (F.col("det_idx") % 5 - 1)
    rows = boxes(spark, sf).withColumn("x2", F.col("x1") + wide)
    sized = rows.withColumns({"width": F.lit(SIZE[0]), "height": F.lit(SIZE[1])})
    return geo.to_label_boxes(sized).select("image_id", "det_idx", "cx", "cy", "w", "h")


DRAGS = """, drags as (
  select image_id, det_idx, x1 / 1024 - 0.1e0 as px, y1 / 640 - 0.1e0 as py,
    x1 / 1024 - 0.1e0 + (mod(det_idx, 9) - 4) / 128.0e0 as qx, y1 / 640 - 0.1e0 + (mod(det_idx, 7) - 3) / 256.0e0 as qy from boxes),
  sides as (select image_id, det_idx,
    least(greatest(0, least(1, px)), greatest(0, least(1, qx))) as l, greatest(greatest(0, least(1, px)), greatest(0, least(1, qx))) as r,
    least(greatest(0, least(1, py)), greatest(0, least(1, qy))) as t, greatest(greatest(0, least(1, py)), greatest(0, least(1, qy))) as b
    from drags)"""


@query(
    sql_over(
        "boxes",
        DRAGS
        + """ select image_id, det_idx, l + (r - l) / 2 as cx, t + (b - t) / 2 as cy, r - l as w, b - t as h
        from sides where r - l >= 0.005e0 and b - t >= 0.005e0""",
    )
)
def dragged_boxes(spark, sf):
    drags = boxes(spark, sf).select(
        "image_id",
        "det_idx",
        (F.col("x1") / 1024 - 0.1).alias("px"),
        (F.col("y1") / 640 - 0.1).alias("py"),
        (F.col("x1") / 1024 - 0.1 + (F.col("det_idx") % 9 - 4) / 128.0).alias("qx"),
        (F.col("y1") / 640 - 0.1 + (F.col("det_idx") % 7 - 3) / 256.0).alias("qy"),
    )
    return geo.drag_to_box(drags, "px", "py", "qx", "qy").select(
        "image_id", "det_idx", "cx", "cy", "w", "h"
    )


# Transforms: every image gets its own size and chances from its number.
SIZED = """, sized as (
  select image_id, det_idx, 640 + mod(image_id, 5) * 128 as width, 512 + mod(image_id, 7) * 64 as height,
    mod(image_id * 7919, 1024) / 1024.0e0 as c1, mod(image_id * 104729, 1024) / 1024.0e0 as c2,
    (x1 + x2) / 2 / 1536 as cx, (y1 + y2) / 2 / 1024 as cy, (x2 - x1) / 1280 as w, (y2 - y1) / 720 as h from boxes)"""


def sized(spark, sf):
    image = F.col("image_id")
    return boxes(spark, sf).select(
        "image_id",
        "det_idx",
        (640 + image % 5 * 128).alias("width"),
        (512 + image % 7 * 64).alias("height"),
        (image * 7919 % 1024 / 1024.0).alias("c1"),
        (image * 104729 % 1024 / 1024.0).alias("c2"),
        ((F.col("x1") + F.col("x2")) / 2 / 1536).alias("cx"),
        ((F.col("y1") + F.col("y2")) / 2 / 1024).alias("cy"),
        ((F.col("x2") - F.col("x1")) / 1280).alias("w"),
        ((F.col("y2") - F.col("y1")) / 720).alias("h"),
    )


SHAPE = ("cx", "cy", "w", "h")


def micro(column):
    """Millionths, shifted so that no value of these tables lies on an edge."""
    return F.floor(F.col(column) * 1e6 + 0.37).alias(column)


def _rounded(df):
    return df.select("image_id", "det_idx", *[micro(c) for c in SHAPE])


ROUNDED = "image_id, det_idx, " + ", ".join(
    f"cast(floor({c} * 1e6 + 0.37e0) as bigint) as {c}" for c in SHAPE
)


@query(
    sql_over(
        "boxes",
        SIZED
        + f""", l as (select *, greatest(width, height)::double as m from sized),
        o as (select image_id, det_idx, (cx * (width / m) * 640 + (640 - (width / m) * 640) / 2) / 640 as cx,
        (cy * (height / m) * 640 + (640 - (height / m) * 640) / 2) / 640 as cy, w * (width / m) as w, h * (height / m) as h from l)
        select {ROUNDED} from o""",
    )
)
def letterboxed(spark, sf):
    return _rounded(geo.letterbox_boxes(sized(spark, sf), 640))


@query(
    sql_over(
        "boxes",
        SIZED
        + f""", o as (select image_id, det_idx, case when c1 < 0.5e0 then 1 - cx else cx end as cx,
        case when c2 < 0.5e0 then 1 - cy else cy end as cy, w, h from sized) select {ROUNDED} from o""",
    )
)
def flipped(spark, sf):
    return _rounded(geo.flip_boxes(sized(spark, sf), "c1", "c2"))


TURNED = SIZED + """, a as (
  select *, radians(case when c1 < 0.8e0 then (c2 * 2 - 1) * 180 else 0 end) as r,
    (cx - 0.5e0) * width as dx, (cy - 0.5e0) * height as dy, w * width / 2 as hw, h * height / 2 as hh from sized),
  turned as (select image_id, det_idx, (dx * cos(r) - dy * sin(r)) / width + 0.5e0 as cx,
    (dx * sin(r) + dy * cos(r)) / height + 0.5e0 as cy,
    (abs(hw * cos(r)) + abs(hh * sin(r))) * 2 / width as w,
    (abs(hw * sin(r)) + abs(hh * cos(r))) * 2 / height as h from a)"""


def _turned(spark, sf):
    return geo.rotate_boxes(sized(spark, sf), geo.random_angle("c1", "c2"))


@query(sql_over("boxes", f"{TURNED} select {ROUNDED} from turned"))
def rotated(spark, sf):
    return _rounded(_turned(spark, sf))


@query(
    sql_over(
        "boxes",
        TURNED
        + f""", e as (select *, greatest(0, least(1, cx - w / 2)) as l, greatest(0, least(1, cx + w / 2)) as r,
        greatest(0, least(1, cy - h / 2)) as t, greatest(0, least(1, cy + h / 2)) as b from turned),
        o as (select image_id, det_idx, (l + r) / 2 as cx, (t + b) / 2 as cy, r - l as w, b - t as h from e
        where (r - l) * (b - t) / (w * h) >= 0.3e0 and r > l and b > t)
        select {ROUNDED} from o""",
    )
)
def visible_boxes(spark, sf):
    return _rounded(geo.visible_boxes(_turned(spark, sf), 0.3))


def drawn(seed, *key):
    """SQL of `geometry.chance`."""
    text = " || '|' || ".join([f"'{seed}'", *[f"{k}::varchar" for k in key]])
    return f"(('0x' || substr(md5({text}), 1, 5))::bigint / 1048576e0)"


@query(
    sql_over(
        "boxes",
        SIZED
        + f""", o as (select image_id, det_idx, case when {drawn(11, "image_id")} < 0.5e0 then 1 - cx else cx end as cx,
        case when {drawn(12, "image_id")} < 0.5e0 then 1 - cy else cy end as cy, w, h from sized) select {ROUNDED} from o""",
    )
)
def hashed_flips(spark, sf):
    """Flips with chances from the image key, as a training job takes them."""
    rows = sized(spark, sf)
    across, down = geo.chance(11, "image_id"), geo.chance(12, "image_id")
    return _rounded(geo.flip_boxes(rows, across, down))


@query(
    sql_over(
        "frames",
        """select count(ms) as runs, avg(ms) as mean_ms, quantile_disc(ms, 0.5) as median_ms
        from (select dt_s * 1024 as ms from frames)""",
    )
)
def latency(spark, sf):
    return detect.latency(
        view(spark, sf, "frames").select((F.col("dt_s") * 1024).alias("inference_ms"))
    )


@query("""select event_type as source, count(value) as runs, min(value) as least,
  max(value) as greatest, true as near_quantiles
from events where value is not null group by event_type""")
def latency_by_source(spark, sf):
    """Daily sketches merged by source; quantiles are held against the ranks of all rows."""
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("source"), F.to_date("ts").alias("day"), "value"
    )
    daily = durable(detect.latency_sketches(rows, ["source", "day"], "value"))
    shares = (0.5, 0.95, 0.99)
    merged = durable(detect.sketched_latency(daily, ["source"], shares))
    both = skew_join(rows, merged, ["source"]).where("value is not null")
    error = 2 * detect.rank_error()
    near = F.lit(True)
    for i, share in enumerate(shares):
        q = F.col("quantiles")[i]
        below = F.avg((F.col("value") < q).cast("int"))
        up_to = F.avg((F.col("value") <= q).cast("int"))
        near = near & (below <= share + error) & (up_to >= share - error)
    return both.groupBy("source", "runs", "least", "greatest").agg(near.alias("near_quantiles"))


# Vocabulary and new names from the part table.
VOCABULARY = """with keyed as (
  select p_brand as class_name, min(p_partkey) as key from part group by p_brand),
  kinds as (select cast(row_number() over (order by key) - 1 as int) as class_id, class_name from keyed)"""


def kinds(spark, sf):
    keyed = (
        table(spark, sf, "part")
        .groupBy(F.col("p_brand").alias("class_name"))
        .agg(F.min("p_partkey").alias("key"))
    )
    return cl.densify(keyed)


@query(f"{VOCABULARY} select * from kinds")
def class_ids(spark, sf):
    return cl.by_id(kinds(spark, sf))


@query(f"{VOCABULARY} select count(*) as classes from kinds")
def class_count(spark, sf):
    return cl.class_count(kinds(spark, sf))


@query(f"{VOCABULARY} select * from kinds where class_name = 'Brand#7'")
def class_position(spark, sf):
    return cl.class_of_name(kinds(spark, sf), "Brand#7")


PAIRS = """, pairs as (select p_partkey, case when mod(p_partkey, 4) = 0 then p_type else p_brand end as source_name,
  case when mod(p_partkey, 3) = 0 then p_name else 'Brand#' || cast(mod(p_partkey, 30) as varchar) end as target_name from part)"""


@query(
    f"""{VOCABULARY} {PAIRS} select p_partkey, source_name, target_name, s.class_id as source_id,
    coalesce(t.class_id, (select cast(count(*) as int) from kinds)) as target_id from pairs
    left join kinds s on s.class_name = source_name left join kinds t on t.class_name = target_name"""
)
def resolved_names(spark, sf):
    part = table(spark, sf, "part").selectExpr(
        "p_partkey",
        "case when p_partkey % 4 = 0 then p_type else p_brand end as source_name",
        "case when p_partkey % 3 = 0 then p_name else concat('Brand#', p_partkey % 30) end as target_name",
    )
    return cl.resolve_names(part, kinds(spark, sf)).select(
        "p_partkey", "source_name", "target_name", "source_id", "target_id"
    )


NEW_NAMES = """, asked as (select p_partkey as ord, trim(case when mod(p_partkey, 17) = 0 then '   '
    when mod(p_partkey, 19) = 0 then repeat('x', 60) when mod(p_partkey, 5) = 0 then p_name
    when mod(p_partkey, 7) = 0 then p_brand when mod(p_partkey, 3) = 0 then ' ' || replace(p_name, ' ', '-') || ' '
    else p_type || '_' || cast(p_size as varchar) end) as name from part),
  judged as (select ord, name, case when name = '' then 'empty'
    when not regexp_full_match(name, '[A-Za-z0-9._-]+') then 'characters' when length(name) > 50 then 'length'
    when name in (select class_name from kinds) or row_number() over (partition by name order by ord) > 1
    then 'duplicate' end as fault from asked)"""


def _asked(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_partkey as ord",
        """case when p_partkey % 17 = 0 then '   ' when p_partkey % 19 = 0 then repeat('x', 60)
        when p_partkey % 5 = 0 then p_name when p_partkey % 7 = 0 then p_brand
        when p_partkey % 3 = 0 then concat(' ', replace(p_name, ' ', '-'), ' ')
        else concat(p_type, '_', p_size) end as name""",
    )


@query(
    f"""{VOCABULARY} {NEW_NAMES} select class_id, class_name from kinds union all
    select cast((select count(*) from kinds) + row_number() over (order by ord) - 1 as int), name
    from judged where fault is null"""
)
def extended_classes(spark, sf):
    return cl.add_classes(kinds(spark, sf), _asked(spark, sf))[0]


@query(f"{VOCABULARY} {NEW_NAMES} select ord, name, fault from judged where fault is not null")
def rejected_classes(spark, sf):
    return cl.add_classes(kinds(spark, sf), _asked(spark, sf))[1]
