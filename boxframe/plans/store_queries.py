"""Queries over the annotation store: label lines, listings, saves, names."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import text
from ..operators import shards, store, versions
from ..operators.groups import durable, scratch_path
from ..operators.naming import unique_names
from ..sources import coco, files, listing
from ..sources.files import coco_labels
from .box_queries import SHAPE, drawn, micro
from .fixtures import sql_over, table, view
from .registry import query


def lines(spark, sf):
    return view(spark, sf, "label_lines")


def images(spark, sf):
    return view(spark, sf, "images")


def parsed(spark, sf):
    return store.parse_label_lines(lines(spark, sf))


def labels(spark, sf):
    return store.valid_labels(parsed(spark, sf))


def millis(column):
    """Milliseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MILLISECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), column)


PARSED = r""", cut as (
  select split, stem, line_no, line, trim(line) as t, regexp_split_to_array(trim(line), '\s+') as p from label_lines),
  parsed as (
    select split, stem, line_no, line, t, p, try_cast(p[1] as int) as class_id, try_cast(p[2] as double) as cx,
      try_cast(p[3] as double) as cy, try_cast(p[4] as double) as w, try_cast(p[5] as double) as h from cut),
  judged as (
    select *, case when t = '' then 'blank' when len(p) <> 5 then 'arity'
      when class_id is null or cx is null or cy is null or w is null or h is null then 'number'
      when class_id < 0 or cx < 0 or cy < 0 or cx > 1 or cy > 1 or w <= 0 or w > 1 or h <= 0 or h > 1 then 'range'
      end as fault from parsed),
  good as (select split, stem, line_no, class_id, cx, cy, w, h from judged where fault is null),
  counts as (select split, stem, count(*) as raw_lines from label_lines where trim(line) <> '' group by split, stem),
  entries as (
    select i.split, i.filename, i.stem, '/api/dataset/image/' || i.split || '/' || i.filename as image_url,
      coalesce(raw_lines, 0) as num_boxes, epoch_ms(i.created_at) as created_ms
    from images i left join counts c on i.split = c.split and i.stem = c.stem)"""

VIEWS = "label_lines images"


def _ms(entries):
    return entries.withColumn("created_ms", millis(F.col("created_at"))).drop("created_at")


@query(sql_over("label_lines", PARSED.split("counts as")[0].rstrip().rstrip(",") + " select * from good"))
def valid_labels(spark, sf):
    return labels(spark, sf)


@query(
    sql_over(
        "label_lines",
        PARSED.split("counts as")[0].rstrip().rstrip(",")
        + " select split, stem, line_no, line, fault from judged where fault <> 'blank'",
    )
)
def rejected_lines(spark, sf):
    return store.rejected_lines(parsed(spark, sf))


@query(sql_over(VIEWS, f"{PARSED} select * from counts"))
def boxes_per_image(spark, sf):
    return store.count_boxes(lines(spark, sf))


@query(
    sql_over(
        VIEWS,
        f"{PARSED} select split, stem, line_no, row_number() over (partition by split, stem order by line_no) as box_no from good",
    )
)
def numbered_boxes(spark, sf):
    return store.number_boxes(labels(spark, sf)).select("split", "stem", "line_no", "box_no")


@query(sql_over(VIEWS, f"{PARSED} select * from entries"))
def all_entries(spark, sf):
    return _ms(store.list_entries(images(spark, sf), lines(spark, sf)))


@query(sql_over(VIEWS, f"{PARSED} select * from entries where split = 'val'"))
def val_entries(spark, sf):
    return _ms(store.list_entries(images(spark, sf), lines(spark, sf), "val"))


@query(
    sql_over(
        VIEWS,
        PARSED
        + """ select * from entries order by created_ms desc,
        case split when 'train' then 1 when 'val' then 2 else 3 end, filename limit 15""",
    )
)
def newest_entries(spark, sf):
    return _ms(store.newest(store.list_entries(images(spark, sf), lines(spark, sf)), 15))


STATS = """, sums as (select split, count(*) as images, sum(num_boxes) as boxes from entries group by split),
  stats as (select s.split, coalesce(images, 0) as images, cast(coalesce(boxes, 0) as bigint) as boxes
    from (values ('train'), ('val'), ('test')) s(split) left join sums on s.split = sums.split)"""


@query(
    sql_over(
        VIEWS,
        f"""{PARSED} {STATS} select * from stats union all
        select 'total', cast(sum(images) as bigint), cast(sum(boxes) as bigint) from stats""",
    )
)
def dataset_stats(spark, sf):
    return store.dataset_stats(images(spark, sf), lines(spark, sf))


def _no_val(spark, sf):
    return images(spark, sf).where("split <> 'val'")


@query(
    sql_over(
        VIEWS,
        """select t > 0 and v > 0 as ready, case when t = 0 then 'no images in train' when v = 0 then 'no images in val' end as reason
        from (select count(*) filter (split = 'train') as t, count(*) filter (split = 'val') as v from images)""",
    )
)
def training_ready(spark, sf):
    return store.training_ready(store.dataset_stats(images(spark, sf), lines(spark, sf)))


@query(
    sql_over(
        VIEWS,
        """select false as ready, 'no images in val' as reason from images where split = 'train' having count(*) > 0""",
    )
)
def training_not_ready(spark, sf):
    return store.training_ready(store.dataset_stats(_no_val(spark, sf), lines(spark, sf)))


# Names asked for: some as saved, some with another extension, some invalid.
ASKED = """, asked as (select distinct 'img_' || cast(c_custkey * 3 as varchar) ||
  case when mod(c_custkey, 13) = 0 then '/x.png' when mod(c_custkey * 3, 11) = 0 then '.jpg' else '.png' end as filename from customer)"""


def asked(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        """concat('img_', c_custkey * 3, case when c_custkey % 13 = 0 then '/x.png'
        when c_custkey * 3 % 11 = 0 then '.jpg' else '.png' end) as filename"""
    )


FOUND = ASKED + """, found as (
  select filename, split, stem, epoch_ms(created_at) as created_ms from (
    select i.*, row_number() over (partition by i.filename order by case split when 'train' then 1 when 'val' then 2 else 3 end) as n
    from images i join asked using (filename)) where n = 1)"""


@query(
    sql_over(
        VIEWS,
        f"""{PARSED} {FOUND} select f.filename, f.split, '/api/dataset/image/' || f.split || '/' || f.filename as image_url,
        count(g.line_no) as num_boxes, any_value(created_ms) as created_ms from found f left join good g
        on f.split = g.split and f.stem = g.stem group by f.filename, f.split""",
    )
)
def found_entries(spark, sf):
    return _ms(store.find_entries(asked(spark, sf), images(spark, sf), lines(spark, sf))[0])


@query(
    sql_over(
        VIEWS,
        f"""{PARSED} {FOUND} select f.filename, g.* from found f join good g on f.split = g.split and f.stem = g.stem""",
    )
)
def found_boxes(spark, sf):
    return store.find_entries(asked(spark, sf), images(spark, sf), lines(spark, sf))[1]


@query(sql_over("images", f"{ASKED} select filename from asked where filename in (select filename from images)"))
def taken_names(spark, sf):
    return store.taken_names(asked(spark, sf), images(spark, sf)).distinct()


@query(sql_over("images", f"{ASKED} select filename from asked where filename not in (select filename from images)"))
def free_names(spark, sf):
    return store.free_names(asked(spark, sf), images(spark, sf)).distinct()


@query(
    sql_over(
        "images",
        "select split, filename, stem, epoch_ms(created_at) as created_ms from images where split = 'train' and filename = 'img_21.png'",
    )
)
def one_image(spark, sf):
    return _ms(store.get_image(images(spark, sf), "train", "img_21.png"))


GONE = """, gone as (select distinct split, case when mod(o, 2) = 0 then filename else stem || '.jpg' end as filename, stem
  from (select *, cast(substr(stem, 5) as bigint) as o from images) where mod(o, 6) < 2)"""


def _gone(spark, sf):
    number = F.substring("stem", 5, 20).cast("bigint")
    name = F.when(number % 2 == 0, F.col("filename")).otherwise(F.concat("stem", F.lit(".jpg")))
    return images(spark, sf).where(number % 6 < 2).select("split", name.alias("filename"))


@query(
    sql_over(
        VIEWS,
        f"{PARSED} {GONE} select split, filename from images i where not exists (select 1 from gone g where g.split = i.split and g.filename = i.filename)",
    )
)
def images_after_delete(spark, sf):
    kept = store.delete_entries(images(spark, sf), labels(spark, sf), _gone(spark, sf))[0]
    return kept.select("split", "filename")


@query(
    sql_over(
        VIEWS,
        f"{PARSED} {GONE} select * from good l where not exists (select 1 from gone g where g.split = l.split and g.stem = l.stem)",
    )
)
def labels_after_delete(spark, sf):
    return store.delete_entries(images(spark, sf), labels(spark, sf), _gone(spark, sf))[1]


@query(
    sql_over(
        VIEWS,
        PARSED
        + """, kept as (select * from good where mod(class_id + line_no, 5) <> 0 and split <> 'test'),
        drawn as (select split, stem, line_no, class_id, cx, cy, w, h, row_number() over (partition by split, stem order by line_no) as k
          from good where cx > 0.5e0),
        last as (select split, stem, max(line_no) as m from kept group by split, stem)
        select * from kept union all
        select d.split, d.stem, cast(coalesce(m, 0) + k as int), class_id, cx, cy, w, h from drawn d
          left join last l on d.split = l.split and d.stem = l.stem""",
    )
)
def edited_boxes(spark, sf):
    # Lines are numbered and parsed once for the four tables.
    base = durable(labels(spark, sf))
    return store.edit_boxes(
        base,
        removed=base.where((F.col("class_id") + F.col("line_no")) % 5 == 0),
        cleared=base.where("split = 'test'").select("split", "stem").distinct(),
        added=base.where("cx > 0.5"),
    )


@query(
    sql_over(
        VIEWS,
        PARSED
        + """ select i.split, i.filename, g.line_no, g.class_id, g.cx, g.cy, g.w, g.h from images i
        left join good g on i.split = g.split and i.stem = g.stem where i.split = 'train'""",
    )
)
def training_rows(spark, sf):
    return store.training_set(images(spark, sf), labels(spark, sf), "train").select(
        "split", "filename", "line_no", "class_id", "cx", "cy", "w", "h"
    )


AUGMENTED = (
    PARSED
    + f""", drawn as (
    select i.filename, g.*, {drawn(1, "g.split", "g.stem")} as c1, {drawn(2, "g.split", "g.stem")} as c2,
      {drawn(3, "g.split", "g.stem")} as c3, {drawn(4, "g.split", "g.stem")} as c4
    from images i join good g on i.split = g.split and i.stem = g.stem),
  boxed as (select * replace ((cy * 0.5625e0 * 640 + 140) / 640 as cy, h * 0.5625e0 as h),
    radians(case when c1 < 0.8e0 then (c2 * 2 - 1) * 180 else 0 end) as r from drawn),
  turned as (select * replace (
    ((cx - 0.5e0) * 640 * cos(r) - (cy - 0.5e0) * 640 * sin(r)) / 640 + 0.5e0 as cx,
    ((cx - 0.5e0) * 640 * sin(r) + (cy - 0.5e0) * 640 * cos(r)) / 640 + 0.5e0 as cy,
    (abs(w * 320 * cos(r)) + abs(h * 320 * sin(r))) * 2 / 640 as w,
    (abs(w * 320 * sin(r)) + abs(h * 320 * cos(r))) * 2 / 640 as h) from boxed),
  flipped as (select * replace (case when c3 < 0.5e0 then 1 - cx else cx end as cx,
    case when c4 < 0.5e0 then 1 - cy else cy end as cy) from turned),
  edges as (select *, greatest(0, least(1, cx - w / 2)) as x0, greatest(0, least(1, cx + w / 2)) as x1,
    greatest(0, least(1, cy - h / 2)) as y0, greatest(0, least(1, cy + h / 2)) as y1 from flipped),
  visible as (select split, filename, stem, line_no, class_id, (x0 + x1) / 2 as cx, (y0 + y1) / 2 as cy,
    x1 - x0 as w, y1 - y0 as h from edges
    where (x1 - x0) * (y1 - y0) / (w * h) >= 0.3e0 and x1 > x0 and y1 > y0)"""
)


def sized_images(spark, sf):
    return images(spark, sf).withColumns({"width": F.lit(1280), "height": F.lit(720)})


@query(
    sql_over(
        VIEWS,
        AUGMENTED
        + " select split, stem, line_no, class_id, "
        + ", ".join(f"cast(floor({c} * 1e6 + 0.37e0) as bigint) as {c}" for c in SHAPE)
        + """ from visible where split = 'train' union all
        select i.split, i.stem, null, null, null, null, null, null from images i
        where split = 'train' and not exists (from good g where g.split = i.split and g.stem = i.stem)""",
    )
)
def training_boxes(spark, sf):
    """A training set with letterboxing, turns, flips and the visibility rule."""
    kept = shards.augmented(sized_images(spark, sf), labels(spark, sf), "train").select(
        "split", "stem", "line_no", "class_id", *[micro(c) for c in SHAPE]
    )
    # An image without boxes is one to learn from, too.
    rows = store.training_set(images(spark, sf), labels(spark, sf), "train")
    empty = [F.lit(None).cast(kept.schema[c].dataType).alias(c) for c in kept.columns[2:]]
    return kept.unionByName(rows.where("line_no is null").select("split", "stem", *empty))


SHARD_BYTES = 20_000


@query(
    sql_over(
        VIEWS,
        AUGMENTED
        + f""", records as (
          select i.split, i.filename, count(v.line_no) as n, octet_length(i.filename::blob) + 40 * count(v.line_no) as bytes,
            md5('0|' || i.split || '|' || i.filename || '|0') as draw
          from images i left join visible v on i.split = v.split and i.filename = v.filename
          where i.split in ('train', 'val') group by i.split, i.filename),
        placed as (select *, coalesce(sum(bytes) over (partition by split order by draw, filename
          rows between unbounded preceding and 1 preceding), 0) // {SHARD_BYTES} as shard from records)
        select split, shard::bigint as shard, count(*) as records, sum(n)::bigint as boxes, sum(bytes)::bigint as bytes
        from placed group by split, shard""",
    )
)
def training_shards(spark, sf):
    """The index of the shards of a training set that was written."""
    return shards.write_training_shards(
        sized_images(spark, sf), labels(spark, sf), scratch_path(spark, "shards"), SHARD_BYTES
    )


@query(
    sql_over(
        VIEWS,
        f"""{PARSED} select split, stem, line_no, (cx - w / 2) * 1280 as px, (cy - h / 2) * 720 as py,
        w * 1280 as pw, h * 720 as ph from good""",
    )
)
def pixel_boxes(spark, sf):
    return labels(spark, sf).select(
        "split", "stem", "line_no", *geo.to_pixels("cx", "cy", "w", "h", F.lit(1280), F.lit(720))
    )


@query(
    sql_over(
        VIEWS,
        PARSED
        + """ select split, stem, cast(class_id as varchar) || ' ' || printf('%.6f', cx) || ' ' || printf('%.6f', cy)
        || ' ' || printf('%.6f', w) || ' ' || printf('%.6f', h) as line from good""",
    )
)
def label_file_lines(spark, sf):
    return labels(spark, sf).select(
        "split", "stem", text.label_line("class_id", "cx", "cy", "w", "h").alias("line")
    )


@query(
    """with names as (select p_partkey, case mod(p_partkey, 6) when 0 then p_name || '.jpg' when 1 then p_name || '.tar.gz'
      when 2 then '.' || replace(p_name, ' ', '_') when 3 then 'a/' || p_name when 4 then p_name || chr(10) else p_brand end as name from part),
    cut as (select *, regexp_extract(name, '(?s)^.+(\\.[^.]+)$', 1) as ext from names)
    select p_partkey, regexp_full_match(name, '[A-Za-z0-9 ._-]+') as valid, ext as suffix,
      substr(name, 1, length(name) - length(ext)) as stem, substr(name, 1, length(name) - length(ext)) || '.png' as png,
      '/api/dataset/image/val/' || name as url from cut"""
)
def file_names(spark, sf):
    named = table(spark, sf, "part").selectExpr(
        "p_partkey",
        """case p_partkey % 6 when 0 then concat(p_name, '.jpg') when 1 then concat(p_name, '.tar.gz')
        when 2 then concat('.', replace(p_name, ' ', '_')) when 3 then concat('a/', p_name)
        when 4 then concat(p_name, chr(10)) else p_brand end as name""",
    )
    return named.select(
        "p_partkey",
        text.valid_file_name("name").alias("valid"),
        text.suffix("name").alias("suffix"),
        text.stem("name").alias("stem"),
        text.png_name("name").alias("png"),
        text.entry_url(F.lit("val"), "name").alias("url"),
    )


@query(
    sql_over(
        "images",
        "select split, stem, 'img_' || cast(epoch_ms(created_at) as varchar) || '.png' as name from images",
    )
)
def default_names(spark, sf):
    rows = images(spark, sf)
    stamped = rows.withColumn("ts", F.timestamp_millis(millis(F.col("created_at"))))
    return stamped.select("split", "stem", text.default_name("ts").alias("name"))


# Save requests from orders. Boxes are JSON text with faults of every kind; names
# collide with each other and with the images already saved.
REQUESTS_SPARK = """select o_orderkey as req_id,
  case when o_orderkey % 23 = 0 then 'dev' when o_orderkey % 3 = 0 then 'val' else 'train' end as split,
  case when o_orderkey % 29 = 0 then '[{{"class_id":0' when o_orderkey % 31 = 0 then '{{"class_id":0}}'
    when o_orderkey % 37 = 0 then '[{{"class_id":0,"cx":1.5,"cy":0.5,"w":0.1,"h":0.1}}]'
    when o_orderkey % 41 = 0 then '[{{"class_id":0,"cx":0.5,"cy":0.5,"w":0.1}}]' when o_orderkey % 5 = 0 then '[]'
    else concat('[{{"class_id":', o_orderkey % 2, ',"cx":0.5,"cy":0.25,"w":0.125,"h":0.5}},{{"class_id":1,"cx":0.75,"cy":0.5,"w":0.25,"h":0.5}}]')
  end as boxes, o_orderkey % 43 <> 0 as has_image,
  case when o_orderkey % 47 = 0 then 'a/b.png' when o_orderkey % 7 = 0 then null
    else concat('img_', cast(floor(o_custkey / 2) as bigint), '.jpg') end as filename, o_orderdate as created_at from {orders}"""

REQUESTS_SQL = """, requests as (select o_orderkey as req_id,
  case when mod(o_orderkey, 23) = 0 then 'dev' when mod(o_orderkey, 3) = 0 then 'val' else 'train' end as split,
  case when mod(o_orderkey, 29) = 0 then 'json' when mod(o_orderkey, 31) = 0 then 'not a list'
    when mod(o_orderkey, 37) = 0 or mod(o_orderkey, 41) = 0 then 'box' end as box_fault,
  mod(o_orderkey, 5) as kind, mod(o_orderkey, 43) <> 0 as has_image,
  case when mod(o_orderkey, 47) = 0 then 'a/b.png' when mod(o_orderkey, 7) = 0 then 'img_' || cast(epoch_ms(o_orderdate) as varchar) || '.png'
    else 'img_' || cast(cast(floor(o_custkey / 2) as bigint) as varchar) || '.jpg' end as filename, epoch_ms(o_orderdate) as created_ms from orders),
  checked as (select *, case when split = 'dev' then 'split' when box_fault is not null then box_fault
    when not has_image then 'no image' when filename = 'a/b.png' then 'filename' end as fault from requests),
  passed as (select *, regexp_replace(filename, '\\.[^.]*$', '.png') as name from checked where fault is null),
  ranked as (select *, row_number() over (partition by name order by req_id) - case when held.filename is null then 1 else 0 end as r
    from passed left join (select distinct filename as filename from images) held on held.filename = passed.name),
  saved as (select req_id, split, kind, created_ms, case when r = 0 then name else replace(name, '.png', '') || ' - ' || cast(r as varchar) || '.png' end as final_name from ranked)"""


def requests(spark, sf):
    rows = spark.sql(REQUESTS_SPARK, orders=table(spark, sf, "orders"))
    return rows.withColumn("ts", F.timestamp_millis(millis(F.col("created_at")))).drop("created_at")


def _saved(spark, sf):
    return store.save_annotations(images(spark, sf), requests(spark, sf))


@query(
    sql_over(
        "images",
        REQUESTS_SQL
        + """ select req_id, split, final_name as filename, replace(final_name, '.png', '') as stem,
        '/api/dataset/image/' || split || '/' || final_name as image_url, case when kind = 0 then 0 else 2 end as num_boxes, created_ms from saved""",
    )
)
def saved_images(spark, sf):
    out = _saved(spark, sf)[0]
    return out.withColumn("created_ms", F.unix_millis("created_at")).drop("created_at")


@query(
    sql_over(
        "images",
        REQUESTS_SQL
        + """ select split, replace(final_name, '.png', '') as stem, n as line_no,
        case when n = 1 then cast(mod(req_id, 2) as int) else 1 end as class_id, case when n = 1 then 0.5e0 else 0.75e0 end as cx,
        case when n = 1 then 0.25e0 else 0.5e0 end as cy, case when n = 1 then 0.125e0 else 0.25e0 end as w, 0.5e0 as h
        from saved, (values (1), (2)) v(n) where kind <> 0""",
    )
)
def saved_labels(spark, sf):
    return _saved(spark, sf)[1]


@query(
    sql_over(
        "images",
        f"{REQUESTS_SQL} select req_id, split, filename, fault from checked where fault is not null",
    )
)
def rejected_saves(spark, sf):
    return _saved(spark, sf)[2]


# The store after a save, a deletion and an edit, each a commit.
COMMITS = f"""{PARSED} {GONE} {REQUESTS_SQL},
  images1 as (select split, filename, stem from images union all
    select split, final_name, replace(final_name, '.png', '') from saved),
  labels1 as (select * from good union all select split, replace(final_name, '.png', ''), n,
    case when n = 1 then cast(mod(req_id, 2) as int) else 1 end, case when n = 1 then 0.5e0 else 0.75e0 end,
    case when n = 1 then 0.25e0 else 0.5e0 end, case when n = 1 then 0.125e0 else 0.25e0 end, 0.5e0
    from saved, (values (1), (2)) v(n) where kind <> 0),
  images2 as (select * from images1 i where not exists (select 1 from gone g where g.split = i.split and g.filename = i.filename)),
  labels2 as (select * from labels1 l where not exists (select 1 from gone g where g.split = l.split and g.stem = l.stem)),
  labels3 as (select * from labels2 where split <> 'test' and line_no <> 2)"""


def _versions_sql(body):
    """The body over each version's images and labels."""
    of = (("images", "good"), ("images1", "labels1"), ("images2", "labels2"), ("images2", "labels3"))
    return sql_over(
        VIEWS,
        COMMITS + " union all ".join(body.format(v=v, images=i, labels=b) for v, (i, b) in enumerate(of)),
    )


def _store_of_commits(spark, sf):
    root = scratch_path(spark, "store")
    versions.create(images(spark, sf), labels(spark, sf), root)
    versions.save(requests(spark, sf), root)
    versions.delete(_gone(spark, sf), root)
    second = versions.read(spark, root, 0)[1].where("line_no = 2")
    test = spark.createDataFrame([("test",)], "split string").join(
        versions.read(spark, root)[1].select("split", "stem").distinct(), "split"
    )
    late = versions.read(spark, root)[1].where("line_no = 2")
    versions.edit(root, removed=second.unionByName(late), cleared=test)
    return root


@query(_versions_sql(" select {v} as version, split, filename from {images}"))
def images_by_version(spark, sf):
    """The images of every snapshot of a store."""
    root = _store_of_commits(spark, sf)
    parts = [
        versions.read(spark, root, v)[0].select(F.lit(v).alias("version"), "split", "filename")
        for v in versions.versions(spark, root)
    ]
    return reduce(DataFrame.unionByName, parts)


@query(_versions_sql(" select {v} as version, split, stem, line_no, class_id, cx, cy, w, h from {labels}"))
def labels_by_version(spark, sf):
    """The label boxes of every snapshot of a store."""
    root = _store_of_commits(spark, sf)
    parts = [
        versions.read(spark, root, v)[1].select(F.lit(v).alias("version"), "split", "stem", "line_no", "class_id", "cx", "cy", "w", "h")
        for v in versions.versions(spark, root)
    ]
    return reduce(DataFrame.unionByName, parts)


# Names asked for again and again over a store with gaps in its numbers.
NAMES_SPARK = {
    "images": """select distinct concat('part ', p_size, case when p_partkey % 4 = 0 then '' else concat(' - ', p_partkey % 60 + 1) end, '.png') as filename
      from {t}""",
    "requests": """select l_orderkey * 8 + row_number() over (partition by l_orderkey
      order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) as req_id,
      concat('part ', l_partkey % 50 + 1, '.png') as filename from {t}""",
}
NAMES_SQL = """with held as (select distinct 'part ' || cast(p_size as varchar) ||
      case when mod(p_partkey, 4) = 0 then '' else ' - ' || cast(mod(p_partkey, 60) + 1 as varchar) end || '.png' as filename
      from part),
  asked as (select l_orderkey * 8 + row_number() over (partition by l_orderkey
      order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) as req_id,
      'part ' || cast(mod(l_partkey, 50) + 1 as varchar) || '.png' as filename from lineitem),
  ranked as (select a.req_id, a.filename, row_number() over (partition by a.filename order by a.req_id)
      - case when h.filename is null then 1 else 0 end as r from asked a left join held h using (filename)),
  most as (select filename, max(r) as m from ranked group by filename),
  numbers as (select filename, unnest(range(1, m + 61)) as n from most),
  free as (select filename, n, row_number() over (partition by filename order by n) as r from numbers
      where replace(filename, '.png', '') || ' - ' || cast(n as varchar) || '.png' not in (select filename from held))
  select req_id, filename, case when ranked.r = 0 then filename else replace(filename, '.png', '') || ' - ' || cast(n as varchar) || '.png' end as final_name
  from ranked left join free using (filename, r)"""


def _names(spark, sf):
    held = spark.sql(NAMES_SPARK["images"], t=table(spark, sf, "part"))
    return held, spark.sql(NAMES_SPARK["requests"], t=table(spark, sf, "lineitem"))


@query(NAMES_SQL)
def unique_file_names(spark, sf):
    return unique_names(*_names(spark, sf))


@query()
def mixed_file_names(spark, sf):
    """Requests that also ask for numbered names, so order decides."""
    held, asked_names = _names(spark, sf)
    mixed = F.when(
        F.col("req_id") % 5 == 0,
        F.regexp_replace("filename", r"\.png$", F.concat(F.lit(" - "), (F.col("req_id") % 40 + 1).cast("string"), F.lit(".png"))),
    ).otherwise(F.col("filename"))
    return unique_names(held, asked_names.withColumn("filename", mixed))


COCO_TABLES = """with ann as (select l_orderkey as image_id, l_linenumber as ann_id, cast(1 + mod(l_partkey, 3) as int) as category_id,
      l_quantity * 4 as x, l_quantity * 2 as y, l_quantity + 8 as w, l_quantity + 4 as h from lineitem),
    img as (select o_orderkey as id, 'shot ' || cast(o_orderkey as varchar) || '.png' as file_name,
      640 + mod(o_orderkey, 4) * 64 as width, 480 + mod(o_orderkey, 3) * 32 as height from orders)"""
COCO_LABELS = """file_name, replace(file_name, '.png', '') as stem, ann_id, category_id - 1 as class_id, (x + w / 2) / width as cx,
      (y + h / 2) / height as cy, w / width as w, h / height as h from ann join img on ann.image_id = img.id"""


def _coco_tables(spark, sf):
    ann = table(spark, sf, "lineitem").selectExpr(
        "l_linenumber as id",
        "l_orderkey as image_id",
        "cast(1 + l_partkey % 3 as int) as category_id",
        "array(l_quantity * 4, l_quantity * 2, l_quantity + 8, l_quantity + 4) as bbox",
    )
    shots = table(spark, sf, "orders").selectExpr(
        "o_orderkey as id",
        "concat('shot ', o_orderkey, '.png') as file_name",
        "640 + o_orderkey % 4 * 64 as width",
        "480 + o_orderkey % 3 * 32 as height",
    )
    return shots, ann


@query(f"{COCO_TABLES} select {COCO_LABELS}")
def coco_boxes(spark, sf):
    shots, ann = _coco_tables(spark, sf)
    return coco_labels(shots, ann, offset=1)


# Images to a COCO document of `coco_documents`, by their ids.
DOCUMENT_IMAGES = 50_000


@query(f"{COCO_TABLES} select cast(floor(ann.image_id / {DOCUMENT_IMAGES}) as bigint) as document, {COCO_LABELS}")
def coco_documents(spark, sf):
    """The boxes of coco_boxes, written as COCO documents and read from them in pieces."""
    shots, ann = _coco_tables(spark, sf)
    number = lambda c: F.floor(F.col(c) / DOCUMENT_IMAGES)
    path = scratch_path(spark, "coco")
    # Objects in an annotation, braces and quotes in strings: what cutting must survive.
    noted = F.struct(F.lit('"}{[' + "\\").alias("note"), F.struct(F.col("id").alias("n")).alias("inner"))
    coco.write_documents(
        shots.withColumn("doc", number("id")),
        ann.withColumns({"doc": number("image_id"), "more": F.when(F.col("image_id") % 3 == 0, noted)}),
        path,
    )
    boxes, _ = coco.read_labels(spark, path, offset=1)
    document = F.regexp_extract("doc", r"/doc=(-?[0-9]+)/", 1).cast("bigint").alias("document")
    return boxes.select(document, *[c for c in boxes.columns if c != "doc"])


# Boxes of an image as a label file.
FILED = (
    "case mod(image_id, 10) when 8 then 'val' when 9 then 'test' else 'train' end as split",
    "concat('shot_', cast(image_id as string)) as stem",
    "cast(det_idx + 1 as int) as line_no",
    "class_id",
)


@query(sql_over("boxes", f"select {', '.join(FILED)} from boxes"))
def packed_label_lines(spark, sf):
    """Boxes written as label files, listed by tasks and read back in packs of 1 MB."""
    root = scratch_path(spark, "labels")
    boxes = view(spark, sf, "boxes")
    share = {"cx": "(x1 + x2) / 2560", "cy": "(y1 + y2) / 1440", "w": "(x2 - x1) / 1280", "h": "(y2 - y1) / 720"}
    filed = boxes.selectExpr(*FILED, *[f"{e} as {c}" for c, e in share.items()])
    files.write_labels(filed, root)
    parsed_lines = store.parse_label_lines(listing.read_label_lines(spark, root, 1 << 20))
    return store.valid_labels(parsed_lines).select("split", "stem", "line_no", "class_id")
