"""How many boxes each box touches, counted without listing a pair.

Boxes that do not touch are apart to the left, right, below or above, and in both
directions at once where they are apart by a corner. So the touching boxes are all,
less those apart by each of the four sides, plus those apart by each of the four
corners. A side is a count of lower values in a sorted line; a corner is a count of
points below a point in both coordinates (dominance).

For dominance, points and queries are range-sorted by the first coordinate, queries
before points of the same value. Points of earlier ranges are counted by the second
coordinate alone: the ranges before range q are, for each bit that is set in q, one
block of that size, and a point counts in the blocks it is in. Points of a query's own
range are counted in the task that has the range, by halves. Each row is copied once
per bit of the number of ranges at most; no image, however large, is in one task.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import CORNERS
from .groups import GROUP_LIMIT, durable, skew_join, split_hot
from .naming import sum_before


def _halves(v, query, weight):
    """For each query in order, the weight of the points before it with a lower v."""
    n, out = len(v), np.zeros(len(v), np.int64)
    place = np.arange(n)
    size = 1
    while size < n:
        pair, right = place // (2 * size), place // size % 2 == 1
        # Queries before points of equal value, as only lower ones count.
        order = np.lexsort((~query, v, pair))
        sums = np.cumsum(np.where(query | right, 0, weight)[order])
        first = np.searchsorted(pair[order], pair[order])
        before = np.concatenate(([0], sums))[first]
        seen = np.zeros(n, np.int64)
        seen[order] = sums - before
        out += np.where(query & right, seen, 0)
        size *= 2
    return out


def _own_range(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["u", "_point", "v", "id"], kind="stable")
    query = ~group["_point"].to_numpy(bool)
    n = _halves(group["v"].to_numpy(), query, group["weight"].to_numpy())
    return pd.DataFrame({"id": group["id"].to_numpy()[query], "n": n[query]})


def dominated(points: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """Per id of `queries` (keys, u, v, id) the weight of the `points` (keys, u, v,
    weight) of its key that are lower in both u and v: id, n."""
    both = points.withColumns({"id": F.lit(-1).cast("long"), "_point": F.lit(True)}).unionByName(
        queries.withColumns({"weight": F.lit(0).cast("long"), "_point": F.lit(False)})
    )
    order = [*keys, "u", "_point", "v", "id"]
    ranged = durable(both.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    last = ranged.agg(F.max("_range")).first()[0] or 0
    inside = ranged.groupBy(*keys, "_range").applyInPandas(_own_range, "id long, n long")
    if not last:
        return inside.groupBy("id").agg(F.sum("n").alias("n"))
    bits = F.sequence(F.lit(0), F.lit(last.bit_length() - 1))
    block = lambda r, b: F.call_function("shiftright", r, b)
    leveled = ranged.withColumn("_bit", F.explode(bits)).withColumn(
        "_block", block(F.col("_range"), F.col("_bit"))
    )
    # Blocks before a range have even numbers: the neighbours of odd ones.
    odd = F.col("_block") % 2 == 1
    key = [*keys, "_bit", "_block"]
    events = leveled.where(F.col("_point") & ~odd).select(*key, "v", "weight")
    marks = leveled.where(~F.col("_point") & odd).select(
        *keys, "_bit", (F.col("_block") - 1).alias("_block"), "v", "id"
    )
    outside = sum_before(marks, events, key, "v", "n").select("id", "n")
    return inside.unionByName(outside).groupBy("id").agg(F.sum("n").alias("n"))


def _sides():
    """Per side and corner: its sign, and the values that must be lower than the query's.

    (x2, x1) reads: the other's x2 below this one's x1.
    """
    left, right = ("x2", "x1", 1), ("x1", "x2", -1)
    below, above = ("y2", "y1", 1), ("y1", "y2", -1)
    return [left, right, below, above], [(a, b) for a in (left, right) for b in (below, above)]


def _sound():
    """Whether a box has four finite corners, the right way round."""
    finite = [F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) for c in CORNERS]
    sound = finite[0] & finite[1] & finite[2] & finite[3]
    return sound & (F.col("x1") <= F.col("x2")) & (F.col("y1") <= F.col("y2"))


def touch_degrees(boxes: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """image_id, det_idx and degree, the number of other boxes of the image that the box
    meets; touching counts. `boxes` has image_id, det_idx and CORNERS.

    A box with a null, infinite or NaN corner, or with corners the wrong way round,
    meets none and is met by none. Images up to `limit` boxes are compared as one array
    each; in larger ones equal boxes are counted as one with its number.
    """
    small, large = split_hot(boxes.select("image_id", "det_idx", *CORNERS), ["image_id"], limit)
    out = _small_degrees(small)
    return out if large is None else out.unionByName(_large_degrees(large))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _met(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series, sound: pd.Series) -> pd.Series:
    """Arrays of corners to arrays of how many others each box meets."""
    out = []
    for a1, b1, a2, b2, kept in zip(x1, y1, x2, y2, sound, strict=True):
        kept = np.asarray(kept, bool)
        a1, b1, a2, b2 = (np.asarray(c, float)[kept] for c in (a1, b1, a2, b2))
        meets = (a1 <= a2[:, None]) & (a1[:, None] <= a2)
        meets &= (b1 <= b2[:, None]) & (b1[:, None] <= b2)
        degree = np.zeros(len(kept), np.int64)
        degree[kept] = meets.sum(1) - 1
        out.append(degree)
    return pd.Series(out)


def _small_degrees(boxes):
    row = F.struct("det_idx", *[F.col(c).cast("double").alias(c) for c in CORNERS], _sound().alias("sound"))
    packed = boxes.groupBy("image_id").agg(F.collect_list(row).alias("b"))
    packed = packed.withColumn("d", _met(*[F.col("b")[c] for c in (*CORNERS, "sound")]))
    each = F.transform(
        "b", lambda b, i: F.struct(b["det_idx"].alias("det_idx"), F.get(F.col("d"), i).alias("degree"))
    )
    return packed.select("image_id", F.explode(each).alias("r")).select("image_id", "r.*")


def _large_degrees(boxes):
    """Degrees in images too large for one task."""
    at = [(F.col(c) + 0.0).alias(c) for c in CORNERS]
    rows = boxes.select("image_id", "det_idx", *at, _sound().alias("_sound"))
    key = ["image_id", *CORNERS]
    once = rows.where("_sound").groupBy(*key).agg(F.count("*").alias("weight"))
    once = durable(once.withColumn("id", F.monotonically_increasing_id()))
    sides, corners = _sides()

    def cases(column, names):
        """One row per case: its number, and the values that the case compares."""
        rows = [
            F.struct(F.lit(i).alias("_case"), *[(F.col(c) * s).alias(n) for n, (c, s) in zip(names, case, strict=True)])
            for i, case in enumerate(column)
        ]
        return F.inline(F.array(*rows))

    side = lambda k: [[(s[k], s[2])] for s in sides]
    corner = lambda k: [[(a[k], a[2]), (b[k], b[2])] for a, b in corners]
    group = ["image_id", "_case"]
    apart = sum_before(
        once.select("image_id", "id", cases(side(1), "v")),
        once.select("image_id", "weight", cases(side(0), "v")),
        group,
        "v",
        "n",
    ).select("id", (-F.col("n")).alias("n"))
    twice = dominated(
        once.select("image_id", "weight", cases(corner(0), "uv")),
        once.select("image_id", "id", cases(corner(1), "uv")),
        group,
    )
    counted = apart.unionByName(twice.select("id", "n")).groupBy("id").agg(F.sum("n").alias("n"))
    total = once.groupBy("image_id").agg(F.sum("weight").alias("total"))
    degree = (F.col("total") + F.col("n") - 1).alias("degree")
    known = skew_join(skew_join(once, counted, ["id"]), total, ["image_id"])
    known = durable(known.select(*key, degree))
    met = F.coalesce(F.when(F.col("_sound"), F.col("degree")), F.lit(0))
    return skew_join(rows, known, key, "left").select("image_id", "det_idx", met.alias("degree"))
