"""Scoring images in batch, and what is done with the detections."""

import hashlib
import sys
import types

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import to_label_boxes
from ..schema import TARGET_CLASS, require_share
from .classes import name_classes, vocabulary
from .cluster import CORNERS, merge_clusters, merge_configured
from .groups import SLICE_ROWS, durable
from .raster import equalize_images

# Size of quantile sketches: ranks are off by 0.55 % of the rows.
SKETCH_K = 800

DETECTED = "det_idx int, x1 double, y1 double, x2 double, y2 double, confidence double, class_id int"


def usable_frames(images):
    """(images with three colour channels, the others)."""
    ok = F.coalesce((F.col("height") > 0) & (F.col("width") > 0) & (F.col("nChannels") == 3), F.lit(False))
    return images.where(ok), images.where(~ok)


def _scorer(key, make_scorer):
    """The scorer of this Python worker, made once per worker and key.

    Workers outlive tasks, modules outlive the functions sent with a task.
    """
    kept = sys.modules.setdefault("_boxframe_scorers", types.ModuleType("_boxframe_scorers"))
    if not hasattr(kept, key):
        setattr(kept, key, make_scorer())
    return getattr(kept, key)


def _score(images, make_scorer, conf):
    """Detections of usable images, with the image's width and height."""
    require_share("conf", conf)
    good = images.select("image_id", "height", "width", "data")
    kind = good.schema["image_id"].dataType.simpleString()
    key = "s" + hashlib.sha256(cloudpickle.dumps(make_scorer)).hexdigest()

    def score(batches):
        scorer = _scorer(key, make_scorer)
        for batch in batches:
            blocks, at = [np.empty((0, 6))], []
            for i, (high, wide, data) in enumerate(
                zip(batch["height"], batch["width"], batch["data"], strict=True)
            ):
                frame = np.frombuffer(data, dtype=np.uint8).reshape(high, wide, 3)
                found = np.asarray(scorer(frame), dtype=float).reshape(-1, 6)
                found = found[found[:, 4] >= conf]
                blocks.append(found)
                at.append(np.stack([np.full(len(found), i), np.arange(len(found))]))
            if not at:
                continue
            found = np.concatenate(blocks)
            image, number = np.concatenate(at, axis=1)
            out = pd.DataFrame(found[:, :5], columns=[*CORNERS, "confidence"])
            out["class_id"] = found[:, 5].astype("int32")
            out.insert(0, "det_idx", number.astype("int32"))
            out.insert(0, "image_id", batch["image_id"].to_numpy()[image])
            out["width"] = batch["width"].to_numpy()[image]
            out["height"] = batch["height"].to_numpy()[image]
            yield out

    return good.mapInPandas(score, f"image_id {kind}, {DETECTED}, width int, height int")


def detect(images: DataFrame, make_scorer, conf: float, classes: DataFrame | None = None):
    """Score images with the caller's function: (detections, images not scored).

    `images` has image_id, height, width, nChannels, data (as the image source
    gives them); those without three channels or that could not be decoded are
    not scored. `make_scorer` runs once per Python worker and returns a function
    from an HxWx3 uint8 array to rows of x1, y1, x2, y2, confidence, class_id.
    Images travel in Arrow batches; set spark.sql.execution.arrow.maxRecordsPerBatch
    low for large ones.
    """
    good, unusable = usable_frames(images)
    dets = _score(good, make_scorer, conf).drop("width", "height")
    return dets if classes is None else name_classes(dets, classes), unusable


def confident(dets, threshold):
    require_share("threshold", threshold)
    return dets.where(F.col("confidence") >= threshold)


def shown_clusters(merged, threshold, target_name=TARGET_CLASS):
    """Cluster boxes left per image after the confidence filter."""
    return merged.groupBy("image_id").agg(
        F.count_if((F.col("class_name") == target_name) & (F.col("confidence") >= threshold)).alias(
            "clusters"
        )
    )


def detection_counts(raw, merged, threshold):
    """Per image: raw boxes, merged boxes that pass, raw boxes that pass."""
    passing = F.count_if(F.col("confidence") >= threshold)
    a = raw.groupBy("image_id").agg(F.count("*").alias("raw"), passing.alias("listed"))
    b = merged.groupBy("image_id").agg(passing.alias("shown"))
    return a.join(b, "image_id", "left").select(
        "image_id", "raw", F.coalesce("shown", F.lit(0)).alias("shown"), "listed"
    )


def latency(runs, column="inference_ms"):
    """Mean and median of a recorded duration."""
    return runs.agg(
        F.count(column).alias("runs"),
        F.avg(column).alias("mean_ms"),
        F.percentile_approx(column, 0.5, 10_000).alias("median_ms"),
    )


def latency_sketches(runs, keys, column="inference_ms", k=SKETCH_K):
    """A quantile sketch of a duration for each key, such as day and source, to be kept.

    Sketches of several thousand bytes at most, whatever the number of rows; they are built
    before the shuffle. Null and NaN durations are left out.
    """
    known = runs.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    return known.groupBy(*keys).agg(
        F.kll_sketch_agg_double(F.col(column).cast("double"), F.lit(k)).alias("sketch")
    )


def sketched_latency(sketches, keys=(), shares=(0.5, 0.95, 0.99)):
    """Runs, least, greatest and quantiles of the sketches that agree in `keys`, merged.

    `least` and `greatest` are exact; the rank of a quantile is off by `rank_error` of
    the rows, with a certainty of 99 %. Without sketches there is no row per key, and
    without keys one of nulls.
    """
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    at = lambda share: F.kll_sketch_get_quantile_double("sketch", F.lit(float(share)))
    n = F.kll_sketch_get_n_double("sketch")
    # A merge of no sketches is an empty sketch, which has no quantiles.
    has = lambda value: F.when(n > 0, value)
    return merged.select(
        *keys,
        n.alias("runs"),
        has(at(0)).alias("least"),
        has(at(1)).alias("greatest"),
        has(F.array(*(at(s) for s in shares))).alias("quantiles"),
    )


def rank_error(k=SKETCH_K):
    """How far the rank of a sketch's quantile may be off, as a share of the rows."""
    return 2.296 / k**0.9021


def nest_predictions(dets, images, part_rows=SLICE_ROWS):
    """Detections as arrays, with the image's size and time; key (image_id, part).

    `images` has image_id, width, height, inference_ms; images without
    detections get an empty array. A part holds `part_rows` places in display
    order, so no array grows without bound; parts count from 0.
    """
    box = F.struct("out_pos", *CORNERS, "confidence", "class_id", "class_name")
    nested = (
        dets.withColumn("part", F.floor(F.col("out_pos") / F.lit(part_rows)).cast("int"))
        .groupBy("image_id", "part")
        .agg(F.array_sort(F.collect_list(box)).alias("detections"))
    )
    empty = F.array().cast(nested.schema["detections"].dataType)
    return images.join(nested, "image_id", "left").select(
        "image_id",
        F.coalesce("part", F.lit(0)).alias("part"),
        F.struct("width", "height").alias("image_size"),
        "inference_ms",
        F.coalesce("detections", empty).alias("detections"),
    )


def write_predictions(dets, images, path, **options):
    nest_predictions(dets, images).write.mode("overwrite").options(**options).parquet(path)


def predict(images, make_scorer, conf, names, merge, contrast=None):
    """Scored images with dense groups merged as `merge` says: (detections, images
    not scored).

    `contrast` (tiles, clip) equalises each image first. Images are decoded once:
    the merge takes their sizes from the scores.
    """
    good, unusable = usable_frames(images)
    if contrast is not None:
        good = equalize_images(good, *contrast)
    classes = vocabulary(images.sparkSession, names)
    # Scoring is the costly step: its rows are written once and read from there.
    dets = durable(_score(good, make_scorer, conf))
    sizes = dets.select("image_id", "width", "height").distinct()
    named = name_classes(dets.drop("width", "height"), classes)
    return merge_configured(named, sizes, merge, names), unusable


def pseudo_labels(dets, sizes, threshold, margin=0.01, min_size=3, **more):
    """Merged, filtered detections as label boxes, numbered in display order.

    Boxes of images without a size stay, without a place.
    """
    merged = confident(
        merge_clusters(dets, sizes, margin=margin, min_size=min_size, **more), threshold
    )
    if isinstance(sizes, DataFrame):
        merged = merged.join(sizes.select("image_id", "width", "height"), "image_id", "left")
    else:
        merged = merged.withColumns({"width": F.lit(sizes[0]), "height": F.lit(sizes[1])})
    return to_label_boxes(merged).select(
        "image_id", "out_pos", "class_id", "cx", "cy", "w", "h"
    )


