"""Suppressing boxes that overlap a better box of the same class."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import intersects, iou
from ..schema import require_share
from .cluster import CORNERS
from .groups import (
    GROUP_LIMIT,
    PUSHED_LIMIT,
    discard,
    durable,
    rank_large,
    skew_join,
    split_hot,
)

# Boxes of one tile that are compared at once, and how many sides wide a tile is.
TILE_ROWS = 1000
TILE_SIDES = 16


def suppress(
    dets: DataFrame,
    threshold: float = 0.45,
    agnostic: bool = False,
    max_per_image: int | None = None,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Keep a box unless a kept box with higher confidence overlaps it too much.

    Boxes are taken by falling confidence, then det_idx, per image and class
    (per image if `agnostic`). `max_per_image` keeps the best boxes only. Boxes
    without area, or with a corner missing, overlap nothing. Groups of more than
    `limit` boxes go by tiles: by one if it can hold the group, else by many, in rounds.
    """
    require_share("threshold", threshold)
    keys = ["image_id"] if agnostic else ["image_id", "class_id"]
    small, large = split_hot(dets, keys, limit)
    out = _suppress_small(small, keys, threshold)
    if large is not None and limit < TILE_ROWS:
        tile, large = split_hot(large, keys, TILE_ROWS)
        out = out.unionByName(_suppress_tile(tile, keys, threshold))
    if large is not None:
        out = out.unionByName(_suppress_large(large, keys, threshold, limit))
    if max_per_image is None:
        return out
    best = [-F.col("confidence"), F.col("det_idx")]
    if max_per_image <= PUSHED_LIMIT:
        window = Window.partitionBy("image_id").orderBy(*best)
        ranked = out.withColumn("_n", F.row_number().over(window))
        return ranked.where(F.col("_n") <= max_per_image).drop("_n")
    ranked = rank_large(out, ["image_id"], best, "_n")
    return ranked.where(F.col("_n") < max_per_image).drop("_n")


def _box(b):
    return [b[c] for c in CORNERS]


def _overlaps(a, b, threshold):
    """Overlap above the threshold; boxes that do not meet are told apart first."""
    return intersects(a, b) & (iou(a, b) > threshold)


def _suppress_small(dets, keys, threshold):
    """One array per group, best box first, folded into the boxes kept."""
    rest = [c for c in dets.columns if c not in (*keys, "det_idx")]
    row = F.struct((-F.col("confidence")).alias("_order"), "det_idx", *rest)
    packed = dets.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("b"))
    kept = F.aggregate(
        "b",
        F.slice("b", F.lit(1), F.lit(0)),
        lambda acc, b: F.when(
            F.exists(acc, lambda k: _overlaps(_box(k), _box(b), threshold)), acc
        ).otherwise(F.concat(acc, F.array(b))),
    )
    return packed.select(*keys, F.explode(kept).alias("r")).select(
        *[c if c in keys else f"r.{c}" for c in dets.columns]
    )


def _flat():
    """Whether a box has no area, or a corner is missing."""
    flat = (F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1"))
    return F.coalesce(flat, F.lit(True))


def _greedy(threshold):
    """Arrays of a group's boxes, best first, to those that are kept."""

    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def kept(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series, flat: pd.Series) -> pd.Series:
        out = []
        for a1, b1, a2, b2, none in zip(x1, y1, x2, y2, flat, strict=True):
            stays = np.ones(len(none), bool)
            at = np.flatnonzero(~np.asarray(none, bool))
            a1, b1, a2, b2 = (np.asarray(c, float)[at] for c in (a1, b1, a2, b2))
            w = np.minimum(a2, a2[:, None]) - np.maximum(a1, a1[:, None])
            h = np.minimum(b2, b2[:, None]) - np.maximum(b1, b1[:, None])
            shared = np.maximum(w, 0) * np.maximum(h, 0)
            area = (a2 - a1) * (b2 - b1)
            close = np.triu(shared / (area + area[:, None] - shared) > threshold, 1)
            gone = np.zeros(len(at), bool)
            for i in np.flatnonzero(close.any(1)):
                if not gone[i]:
                    gone |= close[i]
            stays[at[gone]] = False
            out.append(stays)
        return pd.Series(out)

    return kept


def _suppress_tile(dets, keys, threshold):
    """Groups that one tile can hold: it shows every box all its better neighbours, so all
    are decided in one pass, and the rows are shuffled once."""
    rest = [c for c in dets.columns if c not in (*keys, "det_idx")]
    row = F.struct((-F.col("confidence")).alias("_order"), "det_idx", *rest, _flat().alias("_flat"))
    packed = dets.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("b"))
    sides = [F.col("b")[c].cast("array<double>") for c in CORNERS]
    sure = packed.withColumn("s", _greedy(threshold)(*sides, F.col("b")["_flat"]))
    kept = F.filter("b", lambda b, i: F.get(F.col("s"), i))
    return sure.select(*keys, F.explode(kept).alias("r")).select(
        *[c if c in keys else f"r.{c}" for c in dets.columns]
    )


def _reach(threshold, span):
    """Keys of places, such that two boxes that overlap enough have one in common.

    Overlap above t means both sides differ by a factor below 1/t, and centres by
    less than (1 - t) of the longer side. Sides are put in steps of that factor;
    places of a step are `span` times its longest side wide. The first result is
    the place a box's centre is in, the second all places in which a box that
    overlaps it can have its centre.
    """
    slack = 1.0001
    base = slack / threshold

    def steps(low, high):
        side = F.col(high) - F.col(low)
        step = F.floor(F.log(side) / math.log(base)).cast("int")
        middle = (F.col(low) + F.col(high)) / 2

        def place(at, s):
            return F.floor(at / (F.pow(F.lit(base), s + 1) * span)).cast("long")

        def near(s):
            far = slack * (1 - threshold) * F.greatest(side, F.pow(F.lit(base), s + 1))
            return F.transform(
                F.sequence(place(middle - far, s), place(middle + far, s)),
                lambda c: F.struct(s.alias("step"), c.alias("place")),
            )

        own = F.struct(step.alias("step"), place(middle, step).alias("place"))
        return own, F.flatten(F.transform(F.array(step - 1, step, step + 1), near))

    (own_x, across), (own_y, down) = steps("x1", "x2"), steps("y1", "y2")
    every = F.flatten(
        F.transform(
            across,
            lambda a: F.transform(down, lambda d: F.struct(a.alias("x"), d.alias("y"))),
        )
    )
    return F.struct(own_x.alias("x"), own_y.alias("y")), every


def _first_choice(threshold):
    """Arrays of a tile's boxes, best first, to those of its own that are kept.

    Going down the order, a box that overlaps a kept one goes; one of the tile's
    own whose better neighbours have all gone is kept, as the tile shows all of
    them. Others stay open: a better neighbour at the edge is not yet known.
    """

    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def kept(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        for a1, b1, a2, b2, mine in zip(x1, y1, x2, y2, own):
            area = (a2 - a1) * (b2 - b1)
            sure = np.zeros(len(a1), bool)
            gone = np.zeros(len(a1), bool)
            for i in range(len(a1)):
                w = np.minimum(a2[:i], a2[i]) - np.maximum(a1[:i], a1[i])
                h = np.minimum(b2[:i], b2[i]) - np.maximum(b1[:i], b1[i])
                shared = np.maximum(w, 0) * np.maximum(h, 0)
                close = shared / (area[:i] + area[i] - shared) > threshold
                if (close & sure[:i]).any():
                    gone[i] = True
                elif mine[i] and not (close & ~gone[:i]).any():
                    sure[i] = True
            out.append(sure)
        return pd.Series(out)

    return kept


def _suppress_large(dets, keys, threshold, limit):
    """Groups too large for one array, in rounds, without listing pairs.

    Boxes are dealt to tiles by the place of their centre, and shown to the tiles
    in reach. A tile takes its `TILE_ROWS` best boxes, own or shown, as one array
    and keeps those it can be sure of; a chain of boxes that beat one another is
    resolved as far as the tile goes. Kept boxes then drop those they overlap
    everywhere: boxes kept near one place do not overlap each other, so a box
    meets few of them. Groups that have become small are finished as arrays.
    """
    flat = _flat()
    boxes = durable(dets)
    if threshold >= 1:
        return boxes
    todo = (
        boxes.where(~flat)
        .groupBy(*keys, *CORNERS)
        .agg(F.min(F.struct((-F.col("confidence")).alias("o"), "det_idx")).alias("r"))
        .select(*keys, "r.det_idx", *CORNERS, (-F.col("r.o")).alias("confidence"))
    )
    own, every = _reach(threshold, TILE_SIDES)
    cell, around = _reach(threshold, 1)
    kept = []
    todo = durable(todo)
    while True:
        small, rest = split_hot(todo, keys, limit)
        kept.append(durable(_suppress_small(small, keys, threshold).select(*keys, "det_idx")))
        if rest is None:
            break
        placed = rest.withColumn("own", own).withColumn("tile", F.explode(every))
        best = Window.partitionBy(*keys, "tile").orderBy(-F.col("confidence"), "det_idx")
        top = placed.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= TILE_ROWS)
        row = F.struct("_n", "det_idx", *CORNERS, (F.col("own") == F.col("tile")).alias("mine"))
        tiles = top.groupBy(*keys, "tile").agg(F.array_sort(F.collect_list(row)).alias("b"))
        sides = [F.col("b")[c] for c in (*CORNERS, "mine")]
        sure = tiles.withColumn("s", _first_choice(threshold)(*sides)).select(
            *keys, F.explode(F.filter("b", lambda b, i: F.get(F.col("s"), i))).alias("k")
        )
        won = durable(sure.select(*keys, "k.det_idx", *[F.col(f"k.{c}") for c in CORNERS]))
        kept.append(won.select(*keys, "det_idx"))
        winners = won.withColumn("cell", F.explode(around)).select(
            *keys, "cell", F.struct("det_idx", *CORNERS).alias("k")
        )
        beaten = (
            skew_join(rest.withColumn("cell", cell), winners, keys + ["cell"])
            .where(
                (F.col("det_idx") == F.col("k.det_idx"))
                | (iou(_box(F.col("k")), CORNERS) > threshold)
            )
            .select(*keys, "det_idx")
            .distinct()
        )
        last, todo = todo, durable(skew_join(rest, beaten, keys + ["det_idx"], "left_anti"))
        discard(last)
    names = kept[0]
    for more in kept[1:]:
        names = names.unionByName(more)
    return boxes.where(flat).unionByName(
        skew_join(boxes, names, keys + ["det_idx"], "left_semi")
    )
