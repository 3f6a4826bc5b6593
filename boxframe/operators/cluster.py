"""Merging dense groups of boxes of one class into cluster boxes."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import inflate, margin_pixels
from .graph import connected_components
from .groups import (
    GROUP_LIMIT,
    discard,
    durable,
    rank_large,
    salted_join,
    same_join,
    skew_join,
    split_hot,
)

CORNERS = ("x1", "y1", "x2", "y2")
# Where a crowded cell is cut: at these shares of its boxes' corners.
CUTS = (0.2, 0.4, 0.6, 0.8)


# Up to this many boxes all of them are compared at once.
SQUARE = 256
# Images of up to this many boxes are taken by one task each, by cells if they exceed the
# limit; larger ones are cut into cells by all tasks.
IMAGE_ROWS = 1 << 13


def _touching_groups(x1, y1, x2, y2):
    """For each box the position of the first box it is linked to, itself included.

    A few boxes are compared all at once and take the lowest label they touch
    until nothing changes. With more, one group is grown at a time: a box taken
    from the front is compared with all boxes not yet reached.
    """
    if len(x1) <= SQUARE:
        touch = (x1 <= x2[:, None]) & (x1[:, None] <= x2)
        touch &= (y1 <= y2[:, None]) & (y1[:, None] <= y2)
        first = np.arange(len(x1), dtype=np.int32)
        while len(first):
            low = np.where(touch, first, len(first)).min(axis=1).astype(np.int32)
            low = low[low]
            if np.array_equal(low, first):
                break
            first = low
        return first
    first = np.empty(len(x1), dtype=np.int32)
    rest = np.arange(len(x1))
    while len(rest):
        head, rest = rest[0], rest[1:]
        first[head] = head
        front = [head]
        while front and len(rest):
            b = front.pop()
            hit = (
                (x1[rest] <= x2[b])
                & (x2[rest] >= x1[b])
                & (y1[rest] <= y2[b])
                & (y2[rest] >= y1[b])
            )
            if hit.any():
                found = rest[hit]
                first[found] = head
                front.extend(found)
                rest = rest[~hit]
    return first


def _groups_by_cells(corners, limit):
    """The groups of `_touching_groups` for an image of more than `limit` boxes, by the
    cells of `_large_components`; -1 for a box that is cut where it has no corner."""
    # Equal boxes are one; adding 0 makes a zero's sign no difference.
    rows = np.ascontiguousarray(np.stack(corners, axis=1).astype(float) + 0.0)
    _, rep, fold = np.unique(
        rows.view(f"V{rows.itemsize * 4}").ravel(), return_index=True, return_inverse=True
    )
    rows, fold = rows[rep], fold.ravel()
    parent = np.arange(len(rows))

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    seen = np.zeros(len(rows), bool)
    known = rows[~np.isnan(rows).any(axis=1)]
    low, high = (known[:, :2].min(0) - 1, known[:, 2:].max(0) + 1) if len(known) else ([0, 0], [0, 0])
    cells = [(np.arange(len(rows)), (*low, *high))]
    while cells:
        at, cell = cells.pop()
        x1, y1, x2, y2 = rows[at].T
        covers = (x1 <= cell[0]) & (x2 >= cell[2]) & (y1 <= cell[1]) & (y2 >= cell[3])
        if covers.any():
            to = np.zeros(len(at), int)
        elif len(at) <= limit:
            to = _touching_groups(x1, y1, x2, y2)
        else:
            cells += _cut_cell(at, cell, (x1, y1, x2, y2))
            continue
        seen[at] = True
        for a, b in zip(at.tolist(), at[to].tolist(), strict=True):
            parent[root(a)] = root(b)
    group = np.array([root(i) for i in range(len(rows))])
    first = np.full(len(rows), len(fold))
    np.minimum.at(first, group, rep)
    return np.where(seen, first[group], -1)[fold].astype(np.int32)


def _cut_cell(at, cell, corners):
    """The parts of a cell and their boxes, cut as `_cut_cells` cuts it."""
    inside = [c[(c > cell[k % 2]) & (c < cell[k % 2 + 2])] for k, c in enumerate(corners)]
    axis = 0 if len(inside[0]) + len(inside[2]) >= len(inside[1]) + len(inside[3]) else 1
    cuts = [np.quantile(c, CUTS, method="inverted_cdf") for c in inside[axis::2] if len(c)]
    cuts = np.unique(np.concatenate(cuts)) if cuts else np.empty(0)
    low, high = corners[axis], corners[axis + 2]
    edges = [cell[axis], *cuts, cell[axis + 2]]
    parts = [((low < z) & (high > a), a, z) for a, z in zip(edges, edges[1:])]
    parts += [((low <= c) & (high >= c), c, c) for c in cuts]
    out = []
    for reached, a, z in parts:
        if reached.any():
            part = list(cell)
            part[axis], part[axis + 2] = a, z
            out.append((at[reached], tuple(part)))
    return out


def linked_boxes(min_size: int = 1, limit: int = GROUP_LIMIT):
    """Arrays of corners to arrays of group labels, one array per row.

    A label is the position of the group's first box; for groups below
    `min_size` it is stored as -1 - position. Arrays of more than `limit` boxes go by
    cells; a box that no cell holds has no label.
    """

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def label(
        x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series
    ) -> pd.Series:
        out = []
        for row in zip(x1, y1, x2, y2):
            whole = len(row[0]) <= limit
            first = _touching_groups(*row) if whole else _groups_by_cells(row, limit)
            held = first >= 0
            few = np.bincount(first[held], minlength=len(first))[first] < min_size
            labels = np.where(few, -1 - first, first)
            out.append(labels if held.all() else np.where(held, labels.astype(object), None))
        return pd.Series(out)

    return label


def _field(boxes, name, shift=0.0):
    return F.transform(boxes, lambda b: b[name] + shift)


def _corner_arrays(boxes):
    return [_field(boxes, c) for c in CORNERS]


def box_components(boxes: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """Connected components of intersecting boxes inside each image.

    `boxes` has image_id, det_idx and corners (grown by the margin already).
    Returns image_id, det_idx, comp, where comp is the smallest det_idx of the
    component. Images up to `limit` boxes are solved as one array per image;
    larger ones are cut into cells, in one task up to `IMAGE_ROWS` boxes.
    """
    boxes = boxes.select("image_id", "det_idx", *CORNERS)
    small, large = split_hot(boxes, ["image_id"], max(limit, IMAGE_ROWS))
    out = _small_components(small, limit)
    if large is not None:
        out = out.unionByName(_large_components(large, limit))
    return out


def _small_components(boxes, limit):
    packed = boxes.groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.struct("det_idx", *CORNERS))).alias("b")
    )
    solved = packed.withColumn("g", linked_boxes(1, limit)(*_corner_arrays(F.col("b"))))
    return (
        solved.select(
            "image_id",
            F.explode(
                F.transform(
                    "b",
                    lambda b, i: F.struct(
                        b["det_idx"].alias("det_idx"),
                        F.get(F.col("b"), F.get(F.col("g"), i))["det_idx"].alias("comp"),
                        F.get(F.col("g"), i).alias("at"),
                    ),
                )
            ).alias("r"),
        )
        .where("r.at is not null")
        .select("image_id", "r.det_idx", "r.comp")
    )


def _large_components(boxes, limit):
    """Components of images too large for one task, without listing pairs.

    Equal boxes are folded into one. The rest go into cells, starting with the
    whole image. A cell is a range of x times a range of y; a range is a single
    value or the open interval between two. If some box covers a cell, every box
    in the cell touches that box, so all are linked to the lowest one by an
    aggregate. A cell with few boxes is solved as one array. Any other cell is cut
    at corners of its boxes, and its boxes go to the parts they reach. Two boxes
    that intersect share a point, hence a final cell. The links are then joined up
    over all cells.

    A box that ends on a cut line is in the line's own cell, which it covers, and
    not beyond the line. So each cut leaves a cell a share of its corners, and a
    cell without corners inside is covered: the rounds grow with the logarithm of
    the boxes, whatever the boxes are.
    """
    folded = durable(
        boxes.groupBy("image_id", *CORNERS).agg(F.min("det_idx").alias("rep"))
    )
    extent = folded.groupBy("image_id").agg(
        (F.min("x1") - 1).alias("cx1"),
        (F.min("y1") - 1).alias("cy1"),
        (F.max("x2") + 1).alias("cx2"),
        (F.max("y2") + 1).alias("cy2"),
    )
    cell = ["image_id", "cx1", "cy1", "cx2", "cy2"]
    todo = salted_join(folded, extent, ["image_id"], "rep")
    spans = (
        (F.col("x1") <= F.col("cx1"))
        & (F.col("x2") >= F.col("cx2"))
        & (F.col("y1") <= F.col("cy1"))
        & (F.col("y2") >= F.col("cy2"))
    )
    links, todo = [], durable(todo)
    few, alone = F.col("n") <= limit, F.col("n") == 1
    while True:
        counts = durable(
            todo.groupBy(*cell).agg(
                F.count("*").alias("n"),
                F.min("rep").alias("low"),
                F.bool_or(spans).alias("covered"),
            )
        )
        # A box that is alone in a cell is linked to itself.
        direct = skew_join(
            todo.select(*cell, "rep"), counts.where("covered or n = 1").select(*cell, "low"), cell
        ).select("image_id", F.col("rep").alias("src"), F.col("low").alias("dst"))
        shared = counts.where(~F.col("covered") & few & ~alone).select(*cell)
        packed = (
            skew_join(todo, shared, cell)
            .groupBy(*cell)
            .agg(F.collect_list(F.struct("rep", *CORNERS)).alias("b"))
            .withColumn("g", linked_boxes()(*_corner_arrays(F.col("b"))))
        )
        solved = packed.select(
            "image_id",
            F.explode(
                F.transform(
                    "b",
                    lambda b, i: F.struct(
                        b["rep"].alias("src"),
                        F.get(F.col("b"), F.get(F.col("g"), i))["rep"].alias("dst"),
                    ),
                )
            ).alias("r"),
        ).select("image_id", "r.*")
        links.append(durable(direct.unionByName(solved)))
        crowded = counts.where(~F.col("covered") & ~few).select(*cell)
        if crowded.isEmpty():
            break
        last, todo = todo, _cut_cells(skew_join(todo, crowded, cell), cell)
        todo = durable(todo)
        discard(last, counts)
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    labels = connected_components(durable(edges), ["image_id"]).select(
        "image_id", F.col("node").alias("rep"), "comp"
    )
    named = skew_join(folded, labels, ["image_id", "rep"]).drop("rep")
    return skew_join(boxes, named, ["image_id", *CORNERS]).select(
        "image_id", "det_idx", "comp"
    )


def _cut_cells(todo, cell):
    """Replace each cell by the parts its boxes reach, cut along one axis.

    The axis is the one with more corners inside the cell. Cuts are shares of the
    lower and of the upper corners, so both kinds get fewer in every part.
    """

    def inside(name):
        axis = name[0]
        return (F.col(name) > F.col(f"c{axis}1")) & (F.col(name) < F.col(f"c{axis}2"))

    shares = F.array(*[F.lit(c) for c in CUTS])
    corners = todo.groupBy(*cell).agg(
        *[
            F.percentile_approx(F.when(inside(c), F.col(c)), shares, 1000).alias(f"q{c}")
            for c in CORNERS
        ],
        *[F.count_if(inside(c)).alias(f"n{c}") for c in CORNERS],
    )
    none = F.array().cast("array<double>")

    def cuts(axis):
        both = F.concat(*[F.coalesce(f"q{axis}{k}", none) for k in (1, 2)])
        return F.array_sort(F.array_distinct(both))

    along = F.col("nx1") + F.col("nx2") >= F.col("ny1") + F.col("ny2")
    corners = corners.select(
        *cell, along.alias("along"), F.when(along, cuts("x")).otherwise(cuts("y")).alias("cuts")
    )
    pick = lambda x, y: F.when(F.col("along"), F.col(x)).otherwise(F.col(y))
    todo = skew_join(todo, corners, cell).withColumns(
        {"_low": pick("x1", "y1"), "_high": pick("x2", "y2")}
    )
    edges = F.concat(F.array(pick("cx1", "cy1")), "cuts", F.array(pick("cx2", "cy2")))
    todo = todo.withColumn("_edges", edges)
    open_parts = F.transform(
        F.sequence(F.lit(0), F.size("cuts")),
        lambda i: F.struct(
            F.get(F.col("_edges"), i).alias("a"), F.get(F.col("_edges"), i + 1).alias("z")
        ),
    )
    lines = F.transform("cuts", lambda c: F.struct(c.alias("a"), c.alias("z")))
    reached = F.concat(
        F.filter(open_parts, lambda p: (F.col("_low") < p["z"]) & (F.col("_high") > p["a"])),
        F.filter(lines, lambda p: (F.col("_low") <= p["a"]) & (F.col("_high") >= p["a"])),
    )
    todo = todo.withColumn("_p", F.explode(reached))
    for axis, on in (("x", F.col("along")), ("y", ~F.col("along"))):
        todo = todo.withColumns(
            {
                f"c{axis}1": F.when(on, F.col("_p.a")).otherwise(F.col(f"c{axis}1")),
                f"c{axis}2": F.when(on, F.col("_p.z")).otherwise(F.col(f"c{axis}2")),
            }
        )
    return todo.drop("_p", "_low", "_high", "_edges", "cuts", "along")


def merge_clusters(
    dets: DataFrame,
    sizes,
    source_class_id: int = 0,
    target_class_id: int = 1,
    target_class_name: str | None = None,
    margin: float = 0.01,
    min_size: int = 3,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Replace each dense group of source-class boxes by one target-class box.

    Boxes without a class, and images without a size, pass through unmerged.

    `sizes` is (width, height) or a DataFrame of image_id, width, height. Boxes
    of the source class are grown by `margin` of the longer image side; groups
    linked by overlap with at least `min_size` boxes become one box around them
    with their mean confidence. Everything else passes through. `out_pos` is the
    position in the result: by confidence, or the input order for images with
    too few source boxes. `members` counts the boxes behind a row and
    `first_det` is the first of them.
    """
    info = _image_info(sizes, target_class_id, target_class_name)
    # A box without a class is not of the source class.
    is_other = ~F.col("class_id").eqNullSafe(F.lit(source_class_id))
    return _merge(dets, is_other, info, margin, min_size, limit)


def merge_configured(dets, sizes, params, names, limit: int = GROUP_LIMIT) -> DataFrame:
    """The merge with classes given by name.

    `names` is the vocabulary in order. Nothing is merged if the merge is off or
    the source class is unknown; an unknown target class gets the next free id.
    """
    names = list(names)
    on = params.enabled and params.source_class_name in names
    target = params.target_class_name
    return merge_clusters(
        dets,
        sizes,
        source_class_id=names.index(params.source_class_name) if on else -1,
        target_class_id=names.index(target) if target in names else len(names),
        target_class_name=target,
        margin=params.margin,
        min_size=params.min_size if on else 0,
        limit=limit,
    )


def next_class_id(dets: DataFrame, source_name: str) -> DataFrame:
    """Per image the class id a viewer gives to merged boxes.

    It starts one above the first source box's id; going through the boxes in
    order, an id above it raises it to one above that id. A repeated id changes
    nothing, so only the first box of each class is looked at.
    """
    first = dets.groupBy("image_id", "class_id").agg(
        F.min("det_idx").alias("at"),
        F.min(F.when(F.col("class_name") == source_name, F.col("det_idx"))).alias("source_at"),
    )
    images = first.groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "class_id"))).alias("ids"),
        F.min_by("class_id", "source_at").alias("start"),
        F.min("source_at").alias("seen"),
    )
    folded = F.aggregate(
        "ids",
        F.col("start") + 1,
        lambda acc, r: F.when(r["class_id"] > acc, r["class_id"] + 1).otherwise(acc),
    )
    return images.where("seen is not null").select("image_id", folded.alias("target_id"))


def merge_by_name(
    dets,
    sizes,
    source_name,
    target_name,
    margin=0.01,
    min_size=3,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """The merge as a viewer does it: by class name, with ids found in the image."""
    ids = next_class_id(dets, source_name)
    if isinstance(sizes, DataFrame):
        info = sizes.select("image_id", "width", "height").join(ids, "image_id", "left")
    else:
        info = (
            dets.select("image_id")
            .distinct()
            .join(ids, "image_id", "left")
            .withColumns({"width": F.lit(sizes[0]), "height": F.lit(sizes[1])})
        )
    info = info.withColumn("target_name", F.lit(target_name))
    is_other = ~F.col("class_name").eqNullSafe(source_name)
    return _merge(dets, is_other, info, margin, min_size, limit)


def _image_info(sizes, target_id, target_name):
    given = {
        "target_id": F.lit(target_id).cast("int"),
        "target_name": F.lit(target_name).cast("string"),
    }
    if isinstance(sizes, DataFrame):
        return sizes.select("image_id", "width", "height").withColumns(given)
    return {"width": F.lit(sizes[0]), "height": F.lit(sizes[1]), **given}


def _merge(dets, is_other, info, margin, min_size, limit):
    if "class_name" not in dets.columns:
        dets = dets.withColumn("class_name", F.lit(None).cast("string"))
    dets = dets.select(
        "image_id", "det_idx", *CORNERS, "confidence", "class_id", "class_name"
    ).withColumn("is_other", is_other)
    most = max(limit, IMAGE_ROWS)
    small, large = split_hot(dets, ["image_id"], most)
    if large is not None:
        # Both parts are taken from rows that are made once.
        small, large = split_hot(durable(dets), ["image_id"], most)
    out = _merge_small(small, info, margin, min_size, limit)
    if large is not None:
        labelled = _label_large(large, info, margin, min_size, limit)
        ranked = rank_large(_collapse(labelled), ["image_id"], _sort_key(), "out_pos")
        ranked = ranked.withColumn("out_pos", F.col("out_pos").cast("int"))
        out = out.unionByName(ranked.select(*out.columns))
    return out


def _sort_key():
    active = F.col("active")
    return [
        F.when(active, -F.col("confidence")),
        F.when(active, F.col("is_other")),
        F.when(active, F.col("comp")),
        F.col("first_det"),
    ]


def _collapse(labelled):
    """One row per group: merged groups are keyed by component, others by box."""
    merged = F.col("merged")
    return (
        labelled.withColumn("_unit", F.when(merged, F.col("comp")).otherwise(F.col("det_idx")))
        .groupBy("image_id", "active", "is_other", "merged", "comp", "_unit")
        .agg(
            F.min("x1").alias("x1"),
            F.min("y1").alias("y1"),
            F.max("x2").alias("x2"),
            F.max("y2").alias("y2"),
            F.avg("confidence").alias("confidence"),
            F.min("class_id").alias("class_id"),
            F.min("class_name").alias("class_name"),
            F.min("target_id").alias("target_id"),
            F.min("target_name").alias("target_name"),
            F.count("*").cast("int").alias("members"),
            F.min("det_idx").alias("first_det"),
        )
        .withColumns(
            {
                "class_id": F.when(merged, F.col("target_id")).otherwise(F.col("class_id")),
                "class_name": F.when(merged, F.col("target_name")).otherwise(
                    F.col("class_name")
                ),
            }
        )
    )


def _with_info(df, info):
    if not isinstance(info, DataFrame):
        return df.withColumns(info)
    return df.join(info, "image_id", "left")


def _merge_small(dets, info, margin, min_size, limit):
    """Merge images that fit one array each; the only shuffle is by image."""
    row = F.struct(
        "det_idx", *CORNERS, "confidence", "class_id", "class_name", "is_other"
    )
    packed = dets.groupBy("image_id").agg(F.array_sort(F.collect_list(row)).alias("b"))
    packed = _with_info(packed, info)
    grow = margin_pixels(margin, "width", "height")
    packed = packed.withColumn("s", F.filter("b", lambda b: ~b["is_other"]))
    packed = packed.withColumns(
        {
            "active": F.lit(min_size >= 2) & (F.size("s") >= min_size) & grow.isNotNull(),
            "grow": grow,
        }
    )
    arrays = [
        F.when(F.col("active"), _field("s", c, k * F.col("grow"))).otherwise(
            F.array().cast("array<double>")
        )
        for c, k in zip(CORNERS, (-1, -1, 1, 1))
    ]
    solved = packed.withColumn("g", linked_boxes(min_size, limit)(*arrays))
    leaders = F.filter("g", lambda g, i: g == i)
    solved = solved.withColumn(
        "m",
        F.transform(
            leaders,
            lambda k: F.filter("s", lambda b, i: F.get(F.col("g"), i) == k),
        ),
    )

    def unit(comp, box, corners, confidence, members, class_id, class_name):
        active = F.col("active")
        return F.struct(
            F.when(active, -confidence).alias("k1"),
            F.when(active, box["is_other"]).alias("k2"),
            F.when(active, comp).alias("k3"),
            box["det_idx"].alias("first_det"),
            *[c.alias(n) for n, c in zip(CORNERS, corners)],
            confidence.alias("confidence"),
            class_id.alias("class_id"),
            class_name.alias("class_name"),
            members.cast("int").alias("members"),
        )

    def single(box, comp):
        corners = [box[c] for c in CORNERS]
        return unit(
            comp, box, corners, box["confidence"], F.lit(1), box["class_id"], box["class_name"]
        )

    def cluster(boxes):
        corners = [F.array_min(_field(boxes, c)) for c in CORNERS[:2]]
        corners += [F.array_max(_field(boxes, c)) for c in CORNERS[2:]]
        total = F.aggregate(boxes, F.lit(0.0), lambda acc, b: acc + b["confidence"])
        first = F.get(boxes, F.lit(0))
        return unit(
            first["det_idx"],
            first,
            corners,
            total / F.size(boxes),
            F.size(boxes),
            F.col("target_id"),
            F.col("target_name"),
        )

    def first_of_group(i):
        return F.get(F.col("s"), -1 - F.get(F.col("g"), i))["det_idx"]

    kept = F.filter(
        F.transform("s", lambda b, i: single(b, first_of_group(i))),
        lambda u, i: F.coalesce(F.get(F.col("g"), i) < 0, F.lit(True)),
    )
    others = F.transform(
        F.filter("b", lambda b: b["is_other"]),
        lambda b: single(b, F.lit(None).cast("int")),
    )
    units = F.array_sort(F.concat(F.transform("m", cluster), kept, others))
    return solved.select("image_id", F.posexplode(units).alias("out_pos", "u")).select(
        "image_id",
        "out_pos",
        *[f"u.{c}" for c in CORNERS],
        "u.confidence",
        "u.class_id",
        "u.class_name",
        "u.members",
        "u.first_det",
    )


def _label_large(dets, info, margin, min_size, limit):
    """Label boxes of images larger than one task."""
    grow = margin_pixels(margin, "width", "height")
    image = dets.groupBy("image_id").agg(F.count_if(~F.col("is_other")).alias("sources"))
    if isinstance(info, DataFrame):
        image = same_join(image, info, ["image_id"], "left")
    else:
        image = image.withColumns(info)
    active = F.lit(min_size >= 2) & (F.col("sources") >= min_size) & grow.isNotNull()
    image = image.withColumn("active", active).drop("sources")
    # One row per image and no more: images are joined to their boxes once.
    dets = durable(skew_join(dets, image, ["image_id"]))
    grown = dets.where(~F.col("is_other") & grow.isNotNull()).select(
        "image_id",
        "det_idx",
        *[c.alias(n) for n, c in zip(CORNERS, inflate(*CORNERS, grow))],
    )
    comps = durable(box_components(grown, limit))
    sized = comps.groupBy("image_id", "comp").agg(F.count("*").alias("size"))
    comps = skew_join(comps, sized, ["image_id", "comp"])
    labelled = skew_join(dets, comps, ["image_id", "det_idx"], "left")
    return labelled.withColumn(
        "merged", F.col("active") & F.coalesce(F.col("size") >= min_size, F.lit(False))
    )
