"""Detection, label, frame and run views over the driver's tables.

The same text runs in Spark and in the SQL engine that checks the results.
"""

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)

# Image size of every image in `boxes`.
SIZE = (1280, 720)

BOXES = """
select cast(floor(l_orderkey / 20) as bigint) as image_id, cast(row_number() over (partition
by cast(floor(l_orderkey / 20) as bigint) order by l_orderkey, l_linenumber, l_partkey,
l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
l_shipdate) - 1 as int) as det_idx, case when l_returnflag = 'N' then 1 else 0 end as
class_id, cast(mod(l_partkey * 37, 1240) as double) as x1, cast(mod(l_suppkey * 53 +
l_partkey * 11, 680) as double) as y1, cast(mod(l_partkey * 37, 1240) as double) + 20 +
l_quantity as x2, cast(mod(l_suppkey * 53 + l_partkey * 11, 680) as double) + 10 +
l_quantity as y2, cast(mod(l_orderkey + l_partkey * 3 + l_suppkey * 7, 1024) as double) /
1024 as confidence from lineitem
"""

LABEL_LINES = """
select case when mod(l_orderkey, 10) < 7 then 'train' when mod(l_orderkey, 10) < 9 then
'val' else 'test' end as split, concat('img_', cast(l_orderkey as string)) as stem,
cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey,
l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as
int) as line_no, case when mod(l_partkey, 29) = 0 then '   ' when mod(l_partkey, 31) = 0
then 'x 0.5 0.5 0.1 0.1' when mod(l_partkey, 37) = 0 then '0 0.5 0.5 0.1' when
mod(l_partkey, 41) = 0 then '0 1.5 0.5 0.1 0.1' else concat(case when l_returnflag = 'N'
then '1' else '0' end, ' 0.', lpad(cast(mod(l_partkey * 7919, 1000000) as string), 6, '0'),
' 0.', lpad(cast(mod(l_suppkey * 104729, 1000000) as string), 6, '0'), ' 0.0', lpad(cast(1 +
mod(l_partkey, 997) as string), 5, '0'), ' 0.0', lpad(cast(1 + mod(l_suppkey, 97) as
string), 5, '0')) end as line from lineitem
"""

IMAGES = """
select case when mod(o_orderkey, 10) < 7 then 'train' when mod(o_orderkey, 10) < 9 then
'val' else 'test' end as split, concat('img_', cast(o_orderkey as string)) as stem,
concat('img_', cast(o_orderkey as string), case when mod(o_orderkey, 11) = 0 then '.jpg'
else '.png' end) as filename, o_orderdate as created_at from orders
"""

CLASSES = """
select cast(r_regionkey as int) as class_id, lower(r_name) as class_name from region
"""

FRAMES = """
select mod(user_id, 5) as source, cast(row_number() over (partition by mod(user_id, 5) order
by ts, event_id) as bigint) as read_idx, event_type <> 'error' as ok, cast(case
mod(event_id, 6) when 0 then 0 when 1 then 4 when 2 then 2 else 1 end as double) / 32 as
dt_s, cast(case when mod(event_id, 3) = 0 then mod(event_id, 7) else 0 end as int) as n_dets
from events
"""

LOG_LINES = """
select conv_id as run, cast(turn as int) as seq, concat(chr(27), '[1;36m', role, chr(27),
'[0m ', text) as line from conversations
"""

RUN_EVENTS = """
select conv_id as run, cast(turn as int) as seq, case when turn = 0 then 'start' when role =
'user' and mod(conv_id, 5) = 0 then 'kill' when role = 'assistant' then 'exit' else 'log'
end as kind, case when role = 'assistant' then cast(mod(conv_id, 3) as int) end as
return_code from conversations
"""

VIEWS = {
    "boxes": ("lineitem", BOXES),
    "label_lines": ("lineitem", LABEL_LINES),
    "images": ("orders", IMAGES),
    "classes": ("region", CLASSES),
    "frames": ("events", FRAMES),
    "log_lines": ("conversations", LOG_LINES),
    "run_events": ("conversations", RUN_EVENTS),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered_first(source: str, text: str) -> str:
    """The view's row number taken in a query of its own, below the other columns.

    Spark makes columns that stand beside a window before they are shuffled for it, and
    filters on them afterwards.
    """
    number = re.search(r"cast\(row_number\(\).*?\) as\s+int\)", text, re.DOTALL)[0]
    inner = f"from (select *, {number} as row_no from {source})"
    return re.sub(rf"\bfrom {source}\b", lambda _: inner, text.replace(number, "row_no"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS as a DataFrame."""
    source, text = VIEWS[name]
    if name == "label_lines":
        text = numbered_first(source, text)
    text = re.sub(rf"\bfrom {source}\b", "from {source}", text)
    return spark.sql(text, source=table(spark, sf_dir, source))


def sql_over(names: str, body: str) -> str:
    """SQL text with the named views in front; `body` goes on from there."""
    parts = ", ".join(f"{n} as ({VIEWS[n][1].strip()})" for n in names.split())
    return f"with recursive {parts} {body}"
