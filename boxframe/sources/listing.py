"""Listings made by tasks, and many small files read in packs of equal bytes.

A listing walks folders breadth-first: in each round every folder that was found is
listed by a task, and what it holds is written out, so the driver knows the roots that it
was given and the number of folders, never a file. Files are then laid end to end in the
order of their paths and cut every so many bytes; a pack is read by one task.

Defined results: a root that is missing or empty gives no rows, a root that is a file is that file, empty files
are read as empty contents, a file longer than a pack is read whole by the task of the
pack in which it begins. Files that are gone when they are to be read give null contents.
A folder is listed by one task, and a file is one row.
"""

from datetime import UTC

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stem
from ..operators.groups import durable
from .files import _file_system, _part

# Bytes of files that one task reads, and rows to a batch that leaves it.
PACK = 128 << 20
FILES_TO_BATCH = 256
# Tasks to a core that packs are dealt to, at most.
TASKS = 64
# What opening a file is counted as, so that empty files fill packs too.
OPENING = 64 << 10

_FOUND = pa.schema(
    [
        ("root", pa.string()),
        ("path", pa.string()),
        ("is_folder", pa.bool_()),
        ("length", pa.int64()),
        ("modified", pa.timestamp("us", tz="UTC")),
    ]
)


def _entries(batches):
    """What the folders (root, path) hold; a path that is null is the root itself."""
    for batch in batches:
        for row in batch.to_pylist():
            files, top = _file_system(row["root"])
            path = top if row["path"] is None else row["path"]
            found = files.get_file_info(path)
            if found.type == fs.FileType.Directory:
                found = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
            else:
                found = [found] if found.is_file else []
            rows = [
                (
                    row["root"],
                    f.path,
                    f.type == fs.FileType.Directory,
                    f.size,
                    f.mtime and f.mtime.astimezone(UTC),
                )
                for f in found
            ]
            columns = zip(*rows, strict=True) if rows else [[]] * len(_FOUND)
            arrays = [pa.array(c, t) for c, t in zip(columns, _FOUND.types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=_FOUND)


def list_files(spark, roots, suffix="") -> DataFrame:
    """All files below the roots: root, path, length, modified.

    Roots that lie inside one another list their files once for each.
    """
    schema = "root string, path string, is_folder boolean, length bigint, modified timestamp"
    folders = spark.createDataFrame([(r, None) for r in dict.fromkeys(roots)], "root string, path string")
    rounds, waiting = [], len(set(roots))
    tasks = spark.sparkContext.defaultParallelism * 4
    while waiting:
        # A number of partitions that is given is not merged: folders are rows of few bytes.
        dealt = folders.repartition(min(waiting, tasks))
        found = durable(dealt.mapInArrow(_entries, schema))
        rounds.append(found.where(~F.col("is_folder")))
        folders = found.where("is_folder").select("root", "path")
        waiting = folders.count()
    out = rounds[0] if rounds else spark.createDataFrame([], schema)
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out.where(F.endswith("path", F.lit(suffix))).drop("is_folder")


def packed(listing: DataFrame, size=PACK) -> DataFrame:
    """The listing with `pack`: files end to end by path, cut every `size` bytes."""
    if size < 1:
        raise ValueError("a pack must have room for a byte")
    # The ranges are written, so that a task that is run again sees the same ones.
    ranged = durable(
        listing.repartitionByRange("root", "path").withColumn("_range", F.spark_partition_id())
    )
    weight = F.coalesce("length", F.lit(0)) + F.lit(OPENING)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = ranged.groupBy("_range").agg(F.sum(weight).alias("_bytes"))
    shift = shift.select("_range", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_range").orderBy("root", "path")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_shift") + F.coalesce(F.sum(weight).over(inside), F.lit(0))
    # One row per range: far fewer than files.
    return (
        ranged.join(shift, "_range")
        .withColumn("pack", F.floor(start / size).cast("bigint"))
        .drop("_range", "_shift")
    )


def _read(batches):
    names = ["root", "path", "content"]
    known = {}
    for batch in batches:
        roots, paths = (batch.column(n).to_pylist() for n in ("root", "path"))
        held, size = [], 0
        for root, path in zip(roots, paths, strict=True):
            if root not in known:
                known[root] = _file_system(root)[0]
            try:
                with known[root].open_input_stream(path) as stream:
                    content = stream.read()
            except FileNotFoundError:
                content = None
            held.append((root, path, content))
            size += len(content or b"")
            if len(held) == FILES_TO_BATCH or size >= PACK // 4:
                yield _batch(held, names)
                held, size = [], 0
        if held:
            yield _batch(held, names)


def _batch(rows, names):
    kinds = (pa.string(), pa.string(), pa.binary())
    arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names)


def read_packed(listing: DataFrame, size=PACK) -> DataFrame:
    """Contents of listed files, a pack read by one task: root, path, content.

    Where there are very many packs a task reads several, one after the other.
    """
    packs = durable(packed(listing, size))
    # Numbers that long files have passed over have no pack.
    number = packs.select("pack").distinct().count()
    most = TASKS * listing.sparkSession.sparkContext.defaultParallelism
    dealt = packs.select("root", "path", "pack").repartition(min(max(number, 1), most), "pack")
    return dealt.select("root", "path").mapInArrow(
        _read, "root string, path string, content binary"
    )


def read_label_lines(spark, root, size=PACK) -> DataFrame:
    """Every line of every label file: split, stem, line_no, line; files read in packs."""
    listed = list_files(spark, [f"{root}/labels"], ".txt")
    # Bytes as they are, as the text reader leaves them.
    text = F.col("content").cast("string")
    named = read_packed(listed, size).select(
        _part("path", 2).alias("split"), stem(_part("path", 1)).alias("stem"), text.alias("value")
    )
    named = named.where(F.length("value") > 0)
    return named.select(
        "split", "stem", F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("p", "line")
    ).select("split", "stem", (F.col("p") + 1).alias("line_no"), "line")
