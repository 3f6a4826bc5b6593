"""The annotation store: label lines, image listings, saving and deleting.

Images are keyed by (split, filename), labels by (split, stem): two images that
differ only in extension share their labels.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import (
    default_name,
    entry_url,
    png_name,
    stem,
    valid_file_name,
    valid_split,
    wanted_split,
)
from ..schema import LABEL_BOXES, SPLITS
from .groups import (
    BROADCAST_KEYS,
    SLICE_ROWS,
    computed_once,
    durable,
    number_rows,
    split_hot,
)
from .naming import unique_names

LABEL_KEY = ["split", "stem"]
IMAGE_KEY = ["split", "filename"]

# Numbers as Python reads them from text, without the words for NaN and infinity.
# Possessive: a repeated group that could give back is matched by recursion in the JVM.
_DIGITS = r"\d+(_\d+)*+"
INT_PATTERN = rf"^[+-]?{_DIGITS}\z"
FLOAT_PATTERN = rf"^[+-]?({_DIGITS}\.?({_DIGITS})?|\.{_DIGITS})([eE][+-]?{_DIGITS})?\z"


def _split_rank(split="split"):
    return F.array_position(F.array(*[F.lit(s) for s in SPLITS]), F.col(split))


def box_fault(class_id, cx, cy, w, h):
    """Why a label box is not valid, or null."""
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in (class_id, cx, cy, w, h)])
    low = (F.col(class_id) < 0) | (F.col(cx) < 0) | (F.col(cy) < 0)
    # NaN sorts above every number here, so it falls out at the upper bounds.
    high = (F.col(cx) > 1) | (F.col(cy) > 1)
    size = (F.col(w) <= 0) | (F.col(w) > 1) | (F.col(h) <= 0) | (F.col(h) > 1)
    return F.when(missing, "number").when(low | high | size, "range")


def parse_label_lines(lines: DataFrame) -> DataFrame:
    """Fields of each line, and `fault`: blank, arity, number, range or null.

    `lines` has split, stem, line_no, line.
    """
    text = F.regexp_replace("line", r"^\s+|\s+$", "")
    cut = computed_once(lines, {"_p": F.split(text, r"\s+")})

    def number(i, pattern, kind):
        part = F.get(F.col("_p"), F.lit(i))
        digits = F.when(part.rlike(pattern), F.regexp_replace(part, "_", ""))
        return digits.try_cast(kind)

    parsed = computed_once(
        cut,
        {
            "class_id": number(0, INT_PATTERN, "int"),
            "cx": number(1, FLOAT_PATTERN, "double"),
            "cy": number(2, FLOAT_PATTERN, "double"),
            "w": number(3, FLOAT_PATTERN, "double"),
            "h": number(4, FLOAT_PATTERN, "double"),
        },
    )
    fault = (
        F.when(F.array_join("_p", "") == "", "blank")
        .when(F.size("_p") != 5, "arity")
        .otherwise(box_fault("class_id", "cx", "cy", "w", "h"))
    )
    return parsed.withColumn("fault", fault).drop("_p")


def valid_labels(parsed):
    return parsed.where("fault is null").select(
        *LABEL_KEY, "line_no", "class_id", "cx", "cy", "w", "h"
    )


def rejected_lines(parsed):
    return parsed.where("fault is not null and fault <> 'blank'").select(
        *LABEL_KEY, "line_no", "line", "fault"
    )


def count_boxes(lines):
    """Non-blank lines per label file, valid or not."""
    return (
        lines.where(F.col("line").rlike(r"\S"))
        .groupBy(*LABEL_KEY)
        .agg(F.count("*").alias("raw_lines"))
    )


def number_boxes(labels):
    """Boxes numbered from 1 within their image."""
    return number_rows(labels, LABEL_KEY, "line_no", "box_no")


def with_stem(images):
    return images if "stem" in images.columns else images.withColumn("stem", stem("filename"))


def list_entries(images, lines, split=None):
    """Every image with its address and box count; no label file means 0.

    Order by `newest_first` where it matters.
    """
    chosen = with_stem(images).where(wanted_split("split", split))
    counts = count_boxes(lines.where(wanted_split("split", split)))
    return chosen.join(counts, LABEL_KEY, "left").select(
        "split",
        "filename",
        "stem",
        entry_url("split", "filename").alias("image_url"),
        F.coalesce("raw_lines", F.lit(0)).alias("num_boxes"),
        "created_at",
    )


def newest_first(entries):
    return entries.orderBy(F.desc("created_at"), _split_rank(), "filename")


def newest(entries, n=15):
    """The n newest entries; planned as a top-n, not a full sort."""
    return newest_first(entries).limit(n)


def get_image(images, split, filename):
    """The entry of one image; the split filter prunes partitions."""
    return images.where(
        valid_split("split") & (F.col("split") == split) & (F.col("filename") == filename)
    )


def _first_split(images):
    """One row per filename: the entry of its first split."""
    columns = [c for c in images.columns if c != "filename"]
    best = images.where(valid_split("split")).groupBy("filename").agg(
        F.min_by(F.struct(*columns), _split_rank()).alias("r")
    )
    return best.select("filename", "r.*")


def _chosen(big, small, keys):
    """Rows of `big` whose keys are in `small`; few keys go to all executors."""
    few = small.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return big.join(F.broadcast(small) if few else small.hint("merge"), keys, "left_semi")


def find_entries(requests, images, lines):
    """Look up names over all splits: (entries found with valid box count, boxes).

    Names that are not file names find nothing. Images are cut down to the names
    asked for before their first split is looked for, and label lines to the
    images found before they are parsed.
    """
    names = durable(requests.select("filename").where(valid_file_name("filename")).distinct())
    found = durable(_first_split(_chosen(with_stem(images), names, ["filename"])))
    keys = found.select(*LABEL_KEY).distinct()
    labels = valid_labels(parse_label_lines(_chosen(lines, keys, LABEL_KEY)))
    boxes = found.select("filename", *LABEL_KEY).join(labels, LABEL_KEY)
    counts = boxes.groupBy("filename").agg(F.count("*").alias("num_boxes"))
    entries = found.join(counts, "filename", "left").select(
        "filename",
        "split",
        entry_url("split", "filename").alias("image_url"),
        F.coalesce("num_boxes", F.lit(0)).alias("num_boxes"),
        "created_at",
    )
    return entries, boxes


def taken_names(requests, images):
    """Requested names that exist in some split."""
    return requests.join(images.select("filename"), "filename", "left_semi")


def free_names(requests, images):
    """Requested names that exist in no split."""
    return requests.join(images.select("filename"), "filename", "left_anti")


def dataset_stats(images, lines):
    """Images and boxes per split, zero rows for absent splits, and a total."""
    splits = images.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    sums = (
        list_entries(images, lines)
        .groupBy("split")
        .agg(F.count("*").alias("images"), F.sum("num_boxes").alias("boxes"))
    )
    filled = splits.join(sums, "split", "left").select(
        "split",
        F.coalesce("images", F.lit(0)).alias("images"),
        F.coalesce("boxes", F.lit(0)).alias("boxes"),
    )
    total = filled.agg(
        F.lit("total").alias("split"),
        F.sum("images").alias("images"),
        F.sum("boxes").alias("boxes"),
    )
    return filled.unionByName(total)


def training_ready(stats):
    """One row (ready, reason); the train split is checked before val."""
    images = {
        s: F.coalesce(F.sum(F.when(F.col("split") == s, F.col("images"))), F.lit(0))
        for s in ("train", "val")
    }
    row = stats.agg(images["train"].alias("t"), images["val"].alias("v"))
    reason = F.when(F.col("t") == 0, "no images in train").when(
        F.col("v") == 0, "no images in val"
    )
    return row.select(reason.isNull().alias("ready"), reason.alias("reason"))


def delete_entries(images, labels, keys):
    """(images, labels) without the named entries; unknown names change nothing.

    The labels of a deleted image go even if another image shares its stem.
    """
    gone = with_stem(keys.where(valid_split("split") & valid_file_name("filename")))
    return (
        images.join(gone.select(*IMAGE_KEY), IMAGE_KEY, "left_anti"),
        labels.join(gone.select(*LABEL_KEY), LABEL_KEY, "left_anti"),
    )


def check_requests(requests):
    """Save requests with parsed boxes and `fault`, checked in a fixed order.

    `requests` has req_id (arrival order), split, boxes (JSON text), has_image,
    filename, ts, and decodable where known.
    """
    if "decodable" not in requests.columns:
        requests = requests.withColumn("decodable", F.lit(True))
    text = F.coalesce("boxes", F.lit("[]"))
    kind = F.schema_of_variant(F.try_parse_json(text))
    raw = F.from_json(text, "array<map<string,string>>")
    parsed = computed_once(
        requests,
        {
            "_kind": kind,
            "_raw": raw,
            "label_boxes": F.from_json(text, LABEL_BOXES),
            "filename": F.when(F.coalesce("filename", F.lit("")) == "", default_name("ts"))
            .otherwise(F.col("filename")),
        },
    )

    def bad(i):
        b = F.get(F.col("label_boxes"), i)
        values = [b["class_id"], b["cx"], b["cy"], b["w"], b["h"]]
        missing = reduce(lambda x, y: x | y, [v.isNull() for v in values])
        outside = (
            (values[0] < 0)
            | ~values[1].between(0.0, 1.0)
            | ~values[2].between(0.0, 1.0)
            | (values[3] <= 0)
            | (values[3] > 1)
            | (values[4] <= 0)
            | (values[4] > 1)
        )
        return F.coalesce(missing | outside, F.lit(True))

    is_list = F.coalesce(F.col("_kind").startswith("ARRAY"), F.lit(False))
    count = F.coalesce(F.size("_raw"), F.lit(0))
    faulty = (
        F.col("label_boxes").isNull()
        | (F.size("label_boxes") != count)
        | F.exists("label_boxes", lambda b: b.isNull())
        | F.exists(F.transform("label_boxes", lambda b, i: bad(i)), lambda x: x)
    )
    fault = (
        F.when(~valid_split("split"), "split")
        .when(F.col("_kind").isNull(), "json")
        .when(~is_list, "not a list")
        .when(faulty, "box")
        .when(~F.coalesce("has_image", F.lit(False)), "no image")
        .when(~F.col("decodable"), "not decodable")
        .when(~valid_file_name("filename"), "filename")
    )
    return computed_once(parsed, {"fault": fault}).drop("_kind", "_raw")


def save_annotations(images, requests):
    """Apply save requests to the store: (new images, new labels, rejects).

    Names become .png names and are made unique over all splits in order of
    arrival, so nothing already saved is overwritten.
    """
    checked = durable(check_requests(requests))
    good = checked.where("fault is null").withColumn("filename", png_name("filename"))
    named = unique_names(images, good.select("req_id", "filename"))
    saved = good.drop("filename").join(named, "req_id").withColumn("stem", stem("final_name"))
    new_images = saved.select(
        "req_id",
        "split",
        F.col("final_name").alias("filename"),
        "stem",
        entry_url("split", "final_name").alias("image_url"),
        F.size("label_boxes").alias("num_boxes"),
        F.col("ts").alias("created_at"),
    )
    new_labels = saved.select(
        "split", "stem", F.posexplode("label_boxes").alias("p", "b")
    ).select("split", "stem", (F.col("p") + 1).alias("line_no"), "b.*")
    rejects = checked.where("fault is not null").select("req_id", "split", "filename", "fault")
    return new_images, new_labels, rejects


def edit_boxes(labels, removed=None, cleared=None, added=None):
    """Apply edits: rows by (split, stem, line_no), whole images, new boxes.

    New boxes go behind the boxes that remain, in order of their line_no. Label files with
    new boxes are edited by one task each, after one shuffle, unless they are very long.
    """
    if added is None:
        return _remaining(labels, removed, cleared)
    tables = {"box": labels, "new": added.select(*labels.columns)}
    if removed is not None:
        tables["removed"] = removed.select(*LABEL_KEY, "line_no")
    if cleared is not None:
        tables["cleared"] = cleared.select(*LABEL_KEY)
    marked = [t.withColumn("_kind", F.lit(k)) for k, t in tables.items()]
    marked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
    small, large = split_hot(marked, LABEL_KEY, SLICE_ROWS)
    out = _edited_files(small)
    if large is not None:
        large = durable(large)
        parts = {k: large.where(F.col("_kind") == k).select(*t.columns) for k, t in tables.items()}
        boxes, new = parts.pop("box"), parts.pop("new")
        out = out.unionByName(_edited_long_files(_remaining(boxes, **parts), new))
    return out.select(*labels.columns)


def _remaining(labels, removed=None, cleared=None):
    if cleared is not None:
        labels = labels.join(cleared.select(*LABEL_KEY), LABEL_KEY, "left_anti")
    if removed is not None:
        key = LABEL_KEY + ["line_no"]
        labels = labels.join(removed.select(*key), key, "left_anti")
    return labels


def _edited_files(marked):
    """Boxes that remain and new ones, from rows of all tables with `_kind`."""
    is_kind = lambda k: F.col("_kind") == k
    file = Window.partitionBy(*LABEL_KEY)
    lines = file.orderBy("line_no")
    # As in joins, a null is equal to nothing; new boxes are numbered all the same.
    known = F.col("split").isNotNull() & F.col("stem").isNotNull()
    gone = F.max(is_kind("removed")).over(lines.rangeBetween(0, 0)) & F.col("line_no").isNotNull()
    marked = marked.withColumns(
        {
            "_k": F.count_if(is_kind("new")).over(lines.rowsBetween(Window.unboundedPreceding, 0)),
            "_gone": known & gone,
        }
    )
    left = F.when(is_kind("box") & ~F.col("_gone"), F.col("line_no"))
    marked = marked.withColumns(
        {"_cleared": known & F.max(is_kind("cleared")).over(file), "_last": F.max(left).over(file)}
    )
    last = F.when(known & ~F.col("_cleared"), F.col("_last"))
    line = (F.coalesce(last, F.lit(0)) + F.col("_k")).cast("int")
    return marked.where(is_kind("new") | (is_kind("box") & ~F.col("_gone") & ~F.col("_cleared"))).withColumn(
        "line_no", F.when(is_kind("new"), line).otherwise(F.col("line_no"))
    ).drop("_kind", "_k", "_gone", "_cleared", "_last")


def _edited_long_files(left, added):
    last = left.groupBy(*LABEL_KEY).agg(F.max("line_no").alias("_last"))
    behind = number_rows(added, LABEL_KEY, "line_no", "_k").join(last, LABEL_KEY, "left")
    behind = behind.withColumn(
        "line_no", (F.coalesce("_last", F.lit(0)) + F.col("_k")).cast("int")
    )
    return left.unionByName(behind.select(*left.columns))


def write_training_set(images, labels, path):
    """Images of train and val with their boxes, as Parquet by split.

    Refused, with the reason, unless both splits have images.
    """
    require_both(images)
    sets = [training_set(images, labels, s) for s in ("train", "val")]
    sets[0].unionByName(sets[1]).write.mode("overwrite").partitionBy("split").parquet(path)


def require_both(images):
    """Refuse, with the reason, unless train and val have images."""
    gate = training_ready(images.groupBy("split").agg(F.count("*").alias("images"))).first()
    if not gate.ready:
        raise ValueError(gate.reason)


def in_split(split):
    """Whether a row is of the split, or of one of several."""
    return F.col("split").isin([split] if isinstance(split, str) else list(split))


def training_set(images, labels, split):
    """Images of one split (or several) with their boxes; an image without boxes stays."""
    chosen = with_stem(images).where(in_split(split))
    return chosen.join(labels.where(in_split(split)), LABEL_KEY, "left")

