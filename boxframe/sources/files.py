"""Label files, image files and manifests in the usual folder layout.

    root/images/{split}/{filename}
    root/labels/{split}/{stem}.txt

Paths must be reachable from every executor.
"""

import json
import os
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import yaml
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.text import label_line, stem
from ..operators.classes import names_of, vocabulary
from ..operators.store import LABEL_KEY, parse_label_lines, rejected_lines, valid_labels
from ..schema import SPLITS


def _part(path, n):
    """The n-th part of a path from its end."""
    return F.element_at(F.split(path, "/"), -n)


def read_label_lines(spark, root) -> DataFrame:
    """Every line of every label file: split, stem, line_no, line.

    A label file belongs to one image and is read whole, because lines of a
    split file would have no numbers. Empty files give no rows.
    """
    files = spark.read.text(
        f"{root}/labels", wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True
    )
    path = F.url_decode(F.col("_metadata.file_path"))
    named = files.select(
        _part(path, 2).alias("split"), stem(_part(path, 1)).alias("stem"), "value"
    )
    return named.select(
        "split", "stem", F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("p", "line")
    ).select("split", "stem", (F.col("p") + 1).alias("line_no"), "line")


def read_labels(spark, root):
    """(valid boxes, rejected lines) of all label files."""
    parsed = parse_label_lines(read_label_lines(spark, root))
    return valid_labels(parsed), rejected_lines(parsed)


def list_images(spark, root, split=None) -> DataFrame:
    """Image files with their times; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(f"{root}/images")
    )
    listed = files.select(
        _part("path", 2).alias("split"),
        _part("path", 1).alias("filename"),
        stem(_part("path", 1)).alias("stem"),
        F.col("modificationTime").alias("created_at"),
        "length",
    )
    return listed.where(F.col("split").isin(*([split] if split else SPLITS)))


def read_images(spark, path) -> DataFrame:
    """Decoded images: image_id, height, width, nChannels, data (blue, green, red).

    Files that cannot be decoded stay, with height -1 and no data.
    """
    images = (
        spark.read.format("image")
        .option("dropInvalid", False)
        .option("recursiveFileLookup", True)
        .load(path)
    )
    return images.select(F.url_decode("image.origin").alias("image_id"), "image.*").drop("origin")


def read_bytes(spark, path) -> DataFrame:
    """File contents as they are, for checks on their first bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("image_id"), "length", "content")


@dataclass
class _Staged(WriterCommitMessage):
    """The folder below the job's in which a task has left its files."""

    folder: str


class _LabelWriter(DataSourceWriter):
    """Writes through pyarrow's file systems, so `root` may be a shared store.

    Tasks stage files in a folder of the job. When all have ended, the job notes the
    folders that count in a journal, and only then do files appear under their names.
    A job that fails leaves none; one that dies while it publishes has its journal, and
    `finish_writes` does the rest.
    """

    def __init__(self, root):
        self.root, self.job = root, uuid.uuid4().hex

    def write(self, rows):
        files, root = _file_system(self.root)
        # Another attempt of this task has another folder, which no message names.
        folder, current, out = uuid.uuid4().hex, None, None
        try:
            for row in rows:
                key = (row["split"], row["stem"])
                if key != current:
                    if out is not None:
                        out.close()
                    current = key
                    place = f"{root}/{STAGED}/{self.job}/{folder}/{key[0]}"
                    files.create_dir(place, recursive=True)
                    out = files.open_output_stream(f"{place}/{key[1]}.txt")
                if row["line"] is not None:
                    out.write((row["line"] + "\n").encode())
        finally:
            if out is not None:
                out.close()
        return _Staged(folder)

    def commit(self, messages):
        self.note(messages)
        files, root = _file_system(self.root)
        _publish(files, root, self.job)

    def note(self, messages):
        """Leave the journal, complete or not at all."""
        files, root = _file_system(self.root)
        staged = f"{root}/{STAGED}/{self.job}"
        files.create_dir(staged, recursive=True)
        with files.open_output_stream(f"{staged}/{JOURNAL}.part") as out:
            out.write(json.dumps([m.folder for m in messages if m is not None]).encode())
        files.move(f"{staged}/{JOURNAL}.part", f"{staged}/{JOURNAL}")

    def abort(self, messages):
        files, root = _file_system(self.root)
        _forget(files, f"{root}/{STAGED}/{self.job}")


# Below a root: folders of jobs that have not ended, and a job's list of task folders.
STAGED, JOURNAL = ".staged", "journal.json"
PUBLISHERS = 32


def _found(files, folder, recursive=False):
    return files.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=recursive))


def _forget(files, folder):
    if files.get_file_info(folder).type == fs.FileType.Directory:
        files.delete_dir(folder)


def _publish(files, root, job):
    """Move the files a journal names; those moved before are no longer staged."""
    staged = f"{root}/{STAGED}/{job}"
    with files.open_input_stream(f"{staged}/{JOURNAL}") as journal:
        folders = json.loads(journal.read())

    def move(path, split, name):
        files.move(path, f"{root}/labels/{split}/{name}")

    with ThreadPoolExecutor(PUBLISHERS) as pool:
        for folder in folders:
            found = [f for f in _found(files, f"{staged}/{folder}", True) if f.is_file]
            places = [(f.path, *f.path.split("/")[-2:]) for f in found]
            for split in {split for _, split, _ in places}:
                files.create_dir(f"{root}/labels/{split}", recursive=True)
            list(pool.map(move, *zip(*places, strict=True)) if places else [])
    _forget(files, staged)


def finish_writes(root, abandoned=False):
    """Publish what jobs had decided on when they died; returns their number.

    With `abandoned`, what undecided jobs have staged is deleted as well: give it only
    when no job is writing.
    """
    files, root = _file_system(root)
    done = 0
    for job in [f for f in _found(files, f"{root}/{STAGED}") if f.type == fs.FileType.Directory]:
        if files.get_file_info(f"{job.path}/{JOURNAL}").is_file:
            _publish(files, root, job.base_name)
            done += 1
        elif abandoned:
            _forget(files, job.path)
    return done


def _file_system(root):
    """The file system of a path or URI, and the path in it."""
    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


class LabelFiles(DataSource):
    """Sink that writes one label file per (split, stem), in row order."""

    @classmethod
    def name(cls):
        return "label_files"

    def schema(self):
        return "split string, stem string, line string"

    def writer(self, schema, overwrite):
        return _LabelWriter(self.options["root"])


def write_labels(labels: DataFrame, root, images: DataFrame | None = None) -> DataFrame:
    """Write label files; images without boxes get an empty file.

    A file is written by one task, row by row from sorted input, and replaces
    the old one when the whole job has ended, so neither a task that runs twice nor
    a job that fails changes what is there. Returns the label rows (and images) that were not written, because their split or
    stem is not allowed: split, stem, line_no.
    """
    lines = labels.select(
        *LABEL_KEY, "line_no", label_line("class_id", "cx", "cy", "w", "h").alias("line")
    )
    if images is not None:
        lines = images.select(*LABEL_KEY).distinct().join(lines, LABEL_KEY, "full")
    safe = F.col("split").isin(*SPLITS) & F.col("stem").rlike(r"^[A-Za-z0-9 ._-]+\z")
    safe = F.coalesce(safe, F.lit(False))
    labels.sparkSession.dataSource.register(LabelFiles)
    (
        lines.where(safe)
        .repartition(*LABEL_KEY)
        .sortWithinPartitions(*LABEL_KEY, "line_no")
        .select(*LABEL_KEY, "line")
        .write.format("label_files")
        .option("root", root)
        .mode("append")
        .save()
    )
    return lines.where(~safe).select(*LABEL_KEY, "line_no")


def write_label_table(labels, path):
    """The table form of the labels: parquet by split."""
    labels.write.mode("overwrite").partitionBy("split").parquet(path)


def read_classes(spark, path) -> DataFrame:
    """The vocabulary of a manifest file; one fallback class if it has none."""
    text = None
    if os.path.exists(path):
        with open(path, encoding="utf-8") as file:
            text = file.read()
    return vocabulary(spark, names_of(text))


def write_manifest(path, root, names):
    """Write a manifest unless there is one; says whether it was written."""
    content = {
        "path": os.path.abspath(root),
        **{s: f"images/{s}" for s in SPLITS},
        "names": dict(enumerate(names)),
    }
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    try:
        with open(path, "x", encoding="utf-8") as file:
            yaml.safe_dump(content, file, sort_keys=False)
    except FileExistsError:
        return False
    return True


def extend_manifest(path, names):
    """Put a new list of names into a manifest; what else it says stays.

    The file is replaced in one step.
    """
    try:
        with open(path, encoding="utf-8") as file:
            content = yaml.safe_load(file)
    except (FileNotFoundError, yaml.YAMLError):
        content = None
    content = content if isinstance(content, dict) else {}
    content["names"] = dict(enumerate(names))
    aside = f"{path}.{uuid.uuid4().hex}.part"
    with open(aside, "w", encoding="utf-8") as file:
        yaml.safe_dump(content, file, sort_keys=False)
    os.replace(aside, path)


def read_coco(spark, path, offset=0):
    """Label boxes from COCO annotation files, keyed by image file name.

    Each file is one JSON document and is parsed by one task; `coco.read_labels` cuts
    long ones.
    """
    schema = (
        "images array<struct<id:bigint,file_name:string,width:int,height:int>>,"
        "annotations array<struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>>>"
    )
    doc = spark.read.schema(schema).json(path, multiLine=True)
    return coco_labels(
        doc.select(F.inline("images")), doc.select(F.inline("annotations")), offset
    )


def coco_labels(images, annotations, offset=0, by=()) -> DataFrame:
    """Label boxes from COCO tables; class id is category id minus `offset`.

    `by` names columns that both tables have and within which image ids are unique.
    """
    x, y, w, h = [F.get("bbox", F.lit(i)) for i in range(4)]
    images = images.select(*by, F.col("id").alias("image_id"), "file_name", "width", "height")
    return annotations.withColumnRenamed("id", "ann_id").join(images, [*by, "image_id"]).select(
        *by,
        "file_name",
        stem("file_name").alias("stem"),
        "ann_id",
        (F.col("category_id") - offset).alias("class_id"),
        ((x + w / 2) / F.col("width")).alias("cx"),
        ((y + h / 2) / F.col("height")).alias("cy"),
        (w / F.col("width")).alias("w"),
        (h / F.col("height")).alias("h"),
    )


