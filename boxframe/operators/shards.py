"""Training records with their boxes transformed, in shards bounded by bytes.

A record is an image with its boxes (`PART_LINES` label lines at most; a longer label file
gives several records). Records are put in an order that looks random and depends on the
seed and their key alone, their bytes are added up in that order, and a shard is a stretch
of `shard_bytes` of that sum. So a rerun over the same rows gives the same shards, however
many tasks there are, and a shard is longer than asked for by one record at most.

Large sets are made in passes over a share of the label files each and written in turns over
a stretch of the order each. What a pass or turn has shuffled is deleted when it ends, so the
disk holds a share of the shuffles beside the records.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.text import stem
from .groups import (
    BROADCAST_KEYS,
    SLICE_ROWS,
    discard,
    durable,
    remove,
    same_join,
    scratch_path,
    settings,
)
from .store import LABEL_KEY, in_split, require_both, training_set, with_stem

PART_LINES = SLICE_ROWS
KEY = ["split", "filename", "part"]
TRAINED = ("train", "val")
BOX_BYTES = 40
# Shards of fewer bytes share a folder up to this size: a file each would cost more than its rows.
FOLDER_BYTES = 32 << 20
# Bytes of records that one task puts in order.
RANGE_BYTES = 16 << 20
# Most passes (and turns), and the images or boxes that one pass takes before there are more.
PASSES = 4
PASS_ROWS = 1 << 18
# Shuffles are deleted with the query that made them; a shuffle by label file serves the group
# and join by image that follow it, unless a hot file has to be split.
FREED = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def augmented(images, labels, split, imgsz=640, min_visibility=0.3, seed=0) -> DataFrame:
    """The boxes of a split (or several) letterboxed, turned, mirrored and clipped, as one
    image's boxes are, each by chances from (split, stem). `images` has width and height."""
    of = lambda n: geo.chance(4 * seed + n, "split", "stem")
    chances = {"_angle": geo.random_angle(of(1), of(2)), "_across": of(3), "_down": of(4)}
    # Drawn once for an image, not for each of its boxes.
    drawn = with_stem(images).withColumns(chances)
    rows = training_set(drawn, labels, split).where("line_no is not null")
    boxed = geo.letterbox_boxes(rows, imgsz).withColumns({"width": F.lit(imgsz), "height": F.lit(imgsz)})
    turned = geo.rotate_boxes(boxed, "_angle")
    return geo.visible_boxes(geo.flip_boxes(turned, "_across", "_down"), min_visibility).drop(*chances)


def training_records(images, labels, split, by_stem=None, **how) -> DataFrame:
    """A record per image (and part of its label file), with `boxes`; an image without
    boxes, or without visible ones, has an empty array.

    `by_stem`: every stem is that of the file name, so that images stay where their label
    files are; by default if `images` has no column of stems.
    """
    columns = images.columns
    by_stem = "stem" not in columns if by_stem is None else by_stem
    images = with_stem(images)
    keys = [*LABEL_KEY, "filename"] if by_stem else ["split", "filename"]
    box = F.struct("line_no", "class_id", "cx", "cy", "w", "h")
    part = F.floor((F.col("line_no") - 1) / PART_LINES).cast("int")
    nested = (
        augmented(images, labels, split, **how)
        .groupBy(*keys, part.alias("part"))
        .agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    )
    chosen = images.where(in_split(split))
    # Nothing is broadcast on a guess; hot files are split by adaptive execution. An image
    # without a name has no stem, and so no boxes that a null could meet.
    join = DataFrame.join if by_stem else same_join
    rows = join(chosen, nested.hint("merge"), keys, "left")
    empty = F.array().cast(nested.schema["boxes"].dataType)
    return rows.select(
        *columns,
        F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce("boxes", empty).alias("boxes"),
    )


def record_bytes(records):
    """About the bytes of a record: its name, its boxes and its image, if it is there."""
    size = F.octet_length("filename") + BOX_BYTES * F.size("boxes")
    if "image" in records.columns:
        size = size + F.coalesce(F.octet_length("image"), F.lit(0))
    return size.cast("long")


def record_draw(seed):
    """The text that puts a record in its place; MD5, so its first digits are spread evenly."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in KEY]))


def stretch(draw, n):
    """Which of `n` equal stretches of the order a draw falls in, by its first 32 bits."""
    spot = F.conv(F.substring(draw, 1, 8), 16, 10).cast("long")
    return F.shiftright(spot * n, 32).cast("int")


def share(rows, k, n) -> DataFrame:
    """The rows of one of `n` shares of the stems."""
    return rows if n == 1 else rows.where(F.pmod(F.xxhash64("stem"), F.lit(n)) == k)


def write_records(images, labels, path, seed=0, **how) -> int:
    """Write the records of both splits with `bytes`, each turn of the order to its folder;
    return how many turns there are.

    A pass takes the images and label files of a share of the stems. Where stems are not
    those of the file names, an image could need several shares, and there is one pass.
    Boxes are counted only if the images alone do not ask for all passes.
    """
    columns = images.columns
    images = with_stem(images).where(in_split(TRAINED))
    other = ~F.col("stem").eqNullSafe(stem("filename"))
    rows, others = images.agg(F.count("*"), F.count_if(other)).first()
    by_stem = "stem" not in columns or not others
    if rows < PASSES * PASS_ROWS:
        rows = max(rows, labels.where(in_split(TRAINED)).count())
    turns = max(1, min(PASSES, -(-rows // PASS_ROWS)))
    passes = turns if by_stem else 1
    for k in range(passes):
        own, lines = share(images, k, passes), share(labels, k, passes)
        records = training_records(own, lines, TRAINED, by_stem, seed=seed, **how)
        records = records.select(*columns, "part", "boxes")
        records.withColumns(
            {"bytes": record_bytes(records), "_turn": stretch(record_draw(seed), turns)}
        ).write.mode("append").partitionBy("_turn").parquet(path)
    return turns


def deal_to_shards(records, shift, ranges, shard_bytes, seed=0) -> DataFrame:
    """Records with their shard, and the bytes of their split before them (`place`).

    The records are dealt to `ranges` equal ranges of the order, summed up inside each range
    and shifted by the ranges before (`shift`). Records of one key take each other's places.
    """
    ahead = Window.partitionBy("split", "_range").orderBy("_draw", "filename", "part")
    ahead = ahead.rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("split", "_range", "_draw", "filename", "part")
    few = F.broadcast if ranges <= BROADCAST_KEYS else lambda t: t
    summed = (
        records.withColumn("_draw", record_draw(seed))
        .withColumn("_range", stretch(F.col("_draw"), ranges))
        .withColumn("place", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)))
        .withColumn("_places", F.collect_list("place").over(same))
        .drop("place", "_draw")
    )
    return (
        same_join(summed, few(shift), ["split", "_range"])
        .withColumn("_place", F.explode("_places"))
        .withColumn("place", F.col("_place") + F.col("_shift"))
        .withColumn("shard", F.floor(F.col("place") / shard_bytes).cast("long"))
        .drop("_range", "_shift", "_place", "_places")
    )


def range_shifts(records, ranges, seed=0) -> DataFrame:
    """The bytes of a split before each of its ranges."""
    before = Window.partitionBy("split").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return (
        records.groupBy("split", stretch(record_draw(seed), ranges).alias("_range"))
        .agg(F.sum("bytes").alias("total"))
        .select("split", "_range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("_shift"))
    )


def write_training_shards(images, labels, folder, shard_bytes=128 << 20, seed=0, **how) -> DataFrame:
    """Write the records of both splits as Parquet, and an index of the shards; return the
    index.

    There is a folder for each split and `FOLDER_BYTES` of shards, in order, or for each
    shard if it is as large; `shards` is the first one of a folder. It has a file for each
    task that had rows of it, with rows sorted by `shard` and `place`, so a shard is read by
    its number without the others' row groups.
    `folder`/records is written whole before `folder`/index, so a set without an index is
    not finished. Both must be new.
    """
    spark = images.sparkSession
    path = scratch_path(spark, "records")
    with settings(spark, FREED):
        require_both(images)
        if shard_bytes < 1:
            raise ValueError("shard_bytes must be positive")
        each = max(1, FOLDER_BYTES // shard_bytes)
        first = F.col("shard") - F.col("shard") % each
        # Made once: summed up, then dealt.
        turns = write_records(images, labels, path, seed, **how)
        records = spark.read.parquet(path)
        total = records.agg(F.sum("bytes")).first()[0] or 0
        ranges = turns * max(1, -(-total // (turns * RANGE_BYTES)))
        shift = durable(range_shifts(records, ranges, seed))
        for turn in range(turns):
            mine = records.where(F.col("_turn") == turn).drop("_turn")
            (
                deal_to_shards(mine, shift, ranges, shard_bytes, seed)
                .withColumn("shards", first)
                .sortWithinPartitions("split", "shards", "shard", "place")
                .write.mode("append" if turn else "error")
                .partitionBy("split", "shards")
                .parquet(f"{folder}/records")
            )
            remove(spark, f"{path}/_turn={turn}")
        discard(shift)
        remove(spark, path)
        index = (
            spark.read.parquet(f"{folder}/records")
            .groupBy("split", F.col("shard").cast("long").alias("shard"))
            .agg(
                F.count("*").alias("records"),
                F.sum(F.size("boxes").cast("long")).alias("boxes"),
                F.sum("bytes").alias("bytes"),
            )
        )
        index.write.parquet(f"{folder}/index")
    return spark.read.schema(index.schema).parquet(f"{folder}/index")
