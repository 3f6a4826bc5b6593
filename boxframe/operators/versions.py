"""The annotation store as numbered snapshots that change by commits.

    root/versions/{number}.json          the manifest of a snapshot
    root/data/{table}-{id}/.../part-*    Parquet that manifests name, never changed

A manifest names, per table and part, the folders that hold its rows; a part is a split
and a bucket of stems, so an image and its labels share one. A change reads a snapshot,
writes the parts it touches anew (a save only adds folders) and puts the next manifest,
which must be new: of two changes to one snapshot the second is refused, as names are
unique over the whole store. Readers of a snapshot see it whole, whatever comes later.

The driver holds manifests and the keys of parts, `len(SPLITS)` times `BUCKETS` of them.
Rows whose split is none of SPLITS are refused when a store is made.
"""

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import stem, valid_file_name, valid_split
from ..schema import SPLITS
from .groups import _hadoop_path, durable, put_new, remove, scratch_path
from .store import delete_entries, edit_boxes, save_annotations, with_stem

BUCKETS = 16
TABLES = ("images", "labels")


class Conflict(RuntimeError):
    """Somebody has changed the store since the snapshot that a change was made from."""


def _bucket(buckets):
    return F.pmod(F.xxhash64("stem"), F.lit(buckets)).cast("int")


def _manifest_path(root, version):
    return f"{root}/versions/{version:012d}.json"


def versions(spark, root) -> list[int]:
    """The numbers of all snapshots, rising."""
    path, files = _hadoop_path(spark, f"{root}/versions")
    found = files.listStatus(path) if files.exists(path) else []
    return sorted(int(f.getPath().getName().split(".")[0]) for f in found)


def latest(spark, root) -> int:
    return versions(spark, root)[-1]


def _load(spark, root, version):
    rows = spark.read.text(_manifest_path(root, version), wholetext=True).collect()
    return json.loads(rows[0].value)


def _put(spark, root, version, manifest) -> bool:
    aside = scratch_path(spark, "manifest")
    path, files = _hadoop_path(spark, aside)
    out = files.create(path)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    return put_new(spark, aside, _manifest_path(root, version))


def _write(rows: DataFrame, root, name, buckets):
    """Rows as new folders; a list of folders (below the root) for each part."""
    spark = rows.sparkSession
    top = f"data/{name}-{uuid.uuid4().hex}"
    placed = rows.withColumns({"_split": F.col("split"), "_bucket": _bucket(buckets)})
    # Parts of many rows are written by several tasks.
    placed.hint("rebalance", "_split", "_bucket").write.partitionBy("_split", "_bucket").parquet(f"{root}/{top}")
    path, files = _hadoop_path(spark, f"{root}/{top}")
    parts = {}
    for split in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "_split=*/_bucket=*")):
        a, b = split.getPath().getParent().getName(), split.getPath().getName()
        parts[f"{a.split('=')[1]}/{b.split('=')[1]}"] = [f"{top}/{a}/{b}"]
    return parts, f"{root}/{top}"


def _rows(spark, root, table, parts=None) -> DataFrame:
    """The rows of a table of a manifest, of all parts or some."""
    schema = StructType.fromJson(table["schema"])
    folders = [f for k, v in table["parts"].items() if parts is None or k in parts for f in v]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/{f}" for f in folders])


def read(spark, root, version=None) -> tuple[DataFrame, DataFrame]:
    """(images, labels) of a snapshot, the latest unless one is named."""
    manifest = _load(spark, root, latest(spark, root) if version is None else version)
    return tuple(_rows(spark, root, manifest[t]) for t in TABLES)


def create(images: DataFrame, labels: DataFrame, root, buckets=BUCKETS) -> int:
    """Make a store of images (split, filename, created_at, ...) and labels: version 0."""
    spark = images.sparkSession
    manifest, written = {"buckets": buckets}, []
    for name, rows in zip(TABLES, (with_stem(images), labels), strict=True):
        known = F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))
        rows = rows.withColumn("split", F.when(known, F.col("split")).otherwise(
            F.raise_error(F.concat(F.lit("no such split: "), F.coalesce("split", F.lit("null"))))
        ))
        parts, folder = _write(rows, root, name, buckets)
        manifest[name] = {"schema": json.loads(rows.schema.json()), "parts": parts}
        written.append(folder)
    _commit(spark, root, -1, manifest, written)
    return 0


def _commit(spark, root, base, manifest, written) -> int:
    """Put the manifest behind `base`; what was written goes if somebody else was first."""
    if not _put(spark, root, base + 1, manifest):
        for folder in written:
            remove(spark, folder)
        raise Conflict(f"{root} has changed since version {base}")
    return base + 1


def _base(spark, root, base):
    base = latest(spark, root) if base is None else base
    return base, _load(spark, root, base)


def save(requests: DataFrame, root, base=None) -> tuple[int, DataFrame]:
    """Apply save requests: (the new version, the requests that were rejected)."""
    spark = requests.sparkSession
    base, manifest = _base(spark, root, base)
    images = _rows(spark, root, manifest["images"])
    new_images, new_labels, rejects = save_annotations(images, durable(requests))
    written = []
    for name, rows in zip(TABLES, (new_images, new_labels), strict=True):
        table = manifest[name]
        rows = rows.select(*StructType.fromJson(table["schema"]).names)
        parts, folder = _write(rows, root, name, manifest["buckets"])
        written.append(folder)
        for key, folders in parts.items():
            table["parts"][key] = table["parts"].get(key, []) + folders
    return _commit(spark, root, base, manifest, written), rejects


def _touched(keys: DataFrame, buckets) -> set[str]:
    """The parts that rows with these splits and stems are in."""
    part = F.concat_ws("/", "split", _bucket(buckets))
    return {r[0] for r in keys.where(valid_split("split")).select(part).distinct().collect()}


def _replace(spark, root, manifest, name, rows, touched):
    """Write what is left of the touched parts of a table in place of their folders."""
    parts, folder = _write(rows, root, name, manifest["buckets"])
    kept = {k: v for k, v in manifest[name]["parts"].items() if k not in touched}
    manifest[name]["parts"] = kept | parts
    return folder


def delete(keys: DataFrame, root, base=None) -> int:
    """Delete images by (split, filename), with their labels; returns the new version."""
    spark = keys.sparkSession
    base, manifest = _base(spark, root, base)
    keys = durable(keys.select("split", "filename").where(valid_file_name("filename")))
    touched = _touched(keys.withColumn("stem", stem("filename")), manifest["buckets"])
    before = [_rows(spark, root, manifest[t], touched) for t in TABLES]
    left = delete_entries(*before, keys)
    written = [
        _replace(spark, root, manifest, name, rows, touched)
        for name, rows in zip(TABLES, left, strict=True)
    ]
    return _commit(spark, root, base, manifest, written)


def edit(root, removed=None, cleared=None, added=None, base=None) -> int:
    """Edit label boxes as `store.edit_boxes` does; returns the new version."""
    given = [None if e is None else durable(e) for e in (removed, cleared, added)]
    some = [e for e in given if e is not None]
    if not some:
        raise ValueError("no edits")
    spark = some[0].sparkSession
    base, manifest = _base(spark, root, base)
    touched = set().union(*[_touched(e, manifest["buckets"]) for e in some])
    labels = _rows(spark, root, manifest["labels"], touched)
    written = _replace(spark, root, manifest, "labels", edit_boxes(labels, *given), touched)
    return _commit(spark, root, base, manifest, [written])
