"""Names that are free in every split.

A request keeps its name if it is free when its turn comes; otherwise it gets
the first free `stem - N.ext`, N from 1, gaps included.

Requests that find their name taken get numbers in rising order, passing over
numbers held before and numbers that somebody asked for by full name in time
("won"). The names are worked on by depth, the count of ` - N` at the end of the
stem: who wins a name is settled one depth above, where its number could also be
handed out.
"""

import bisect

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.text import stem, suffix
from .groups import deal, durable, in_ranges, number_rows, shifted, skew_join

NUMBERED = r"(?s)^(.+) - ([1-9][0-9]*)\z"
CHAIN = r"(?s)^.+?(( - [1-9][0-9]*)+)\z"


def _parsed(names):
    """Adds depth and, for numbered names, parent and n."""
    chain = F.regexp_extract(stem("filename"), CHAIN, 1)
    number = F.regexp_extract(stem("filename"), NUMBERED, 2).try_cast("bigint")
    parent = F.concat(F.regexp_extract(stem("filename"), NUMBERED, 1), suffix("filename"))
    return names.withColumns(
        {
            "depth": F.size(F.split(chain, " - ")) - 1,
            "n": number,
            "parent": F.when(number.isNotNull(), parent),
        }
    )


def sum_before(marks, events, keys, order, out):
    """For each mark the total `weight` of events of its key with a lower `order`.

    Both sides are range-sorted together; one sum per key and range gives what
    lies before it. Equal places are in one range.
    """
    both = marks.withColumns({"weight": F.lit(0).cast("bigint"), "_mark": F.lit(True)})
    both = both.unionByName(
        events.select(*keys, order, F.col("weight").cast("bigint").alias("weight")),
        allowMissingColumns=True,
    )
    rows = marks.count() + events.count()
    both = in_ranges(both, rows, [*keys, order])
    line = Window.partitionBy(*keys).orderBy("_range")
    earlier = F.sum("_sum").over(line.rowsBetween(Window.unboundedPreceding, -1))
    offsets = (
        both.groupBy(*keys, "_range")
        .agg(F.sum("weight").alias("_sum"))
        .select(*keys, "_range", F.coalesce(earlier, F.lit(0)).alias("_offset"))
    )
    below = Window.partitionBy(*keys, "_range").orderBy(order)
    if isinstance(both.schema[order].dataType, IntegralType):
        inside = F.sum("weight").over(below.rangeBetween(Window.unboundedPreceding, -1))
    else:
        # A step of 1 is no next value here: what is equal is taken off again.
        equal = Window.partitionBy(*keys, "_range", order)
        inside = F.sum("weight").over(below.rangeBetween(Window.unboundedPreceding, 0))
        inside = inside - F.sum("weight").over(equal)
    # Summed up where the rows were dealt, then shifted by the ranges before.
    summed = deal(both, rows, [*keys, "_range"]).withColumn(out, F.coalesce(inside, F.lit(0)))
    return (
        shifted(summed.where("_mark"), offsets, [*keys, "_range"])
        .withColumn(out, F.col("_offset") + F.col(out))
        .drop("_mark", "_range", "_offset", "weight")
    )


def unique_names(images: DataFrame, requests: DataFrame) -> DataFrame:
    """`final_name` for each request; req_id, a whole number, is the arrival order."""
    asked = durable(_parsed(requests.select("req_id", "filename")))
    held = durable(_parsed(images.select("filename").distinct()))
    first = asked.groupBy("filename", "depth", "n", "parent").agg(F.min("req_id").alias("first"))
    # Each name's first request, where nobody holds the name from before.
    first = durable(skew_join(first, held.select("filename"), ["filename"], "left_anti"))
    deepest = asked.agg(F.max("depth")).first()[0]
    won = first.where("depth = 0").select("filename", "first")
    parts = []
    for depth in range((deepest or 0) + 1):
        level = asked.where(F.col("depth") == depth).select("req_id", "filename")
        level = skew_join(level, won, ["filename"], "left")
        keeps = F.coalesce(F.col("req_id") == F.col("first"), F.lit(False))
        parts.append(
            level.where(keeps).select("req_id", "filename", F.col("filename").alias("final_name"))
        )
        over = durable(
            number_rows(level.where(~keeps).drop("first"), ["filename"], "req_id", "rank")
        )
        used = held.where(F.col("depth") == depth + 1).where("n is not null")
        used = used.select(F.col("parent").alias("filename"), "n", F.lit(1).alias("weight"))
        rivals = first.where(F.col("depth") == depth + 1)
        if depth < (deepest or 0):
            won = durable(_winners(rivals, over, used))
            taken = skew_join(rivals, won.select("filename"), ["filename"], "left_semi")
            used = used.unionByName(
                taken.where("n is not null").select(
                    F.col("parent").alias("filename"), "n", F.lit(1).alias("weight")
                )
            )
        parts.append(_numbered(over, used))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


class WinMap:
    """What a run of numbers makes of the wins before it.

    A number wins if the wins before it are fewer than its room. As a function of the
    wins w before a run, the wins after it rise by 0 or 1 with each w, so it is
    `base`, its value at 0, plus w, less the `flat` steps below w where it does not
    rise. A further number adds one up to the step that takes the function from below
    its room to its room, and that step becomes flat.
    """

    def __init__(self):
        self.base, self.flat = 0, []

    def add(self, room):
        rising = room - 1 - self.base
        if rising >= 0:
            bisect.insort(self.flat, self._rising_step(rising))
            self.base += 1

    def _rising_step(self, k):
        """The k-th step (from 0) that is not flat."""
        low, high = 0, len(self.flat)
        while low < high:
            mid = (low + high) // 2
            if self.flat[mid] - mid <= k:
                low = mid + 1
            else:
                high = mid
        return k + low


def wins_after(before, base, flat):
    return base + before - bisect.bisect_left(flat, before)


# Numbers of one parent whose map is made by one pass.
RUN = 1 << 14


def _runs(batches):
    """Batches of sorted marks as (parent, range, run) and its marks in order."""
    for batch in batches:
        yield from zip(
            batch["filename"], batch["_range"], batch["_run"], batch["name"], batch["first"], batch["room"]
        )


def _winners(rivals, over, used):
    """Numbered names whose first request comes before the number is handed out.

    A number n is the u-th to be handed out, where u is n less the used and the
    won numbers below it. Its request wins if fewer than u requests for the
    parent found it taken before, that is if fewer numbers below it won than that
    leaves room for. The sorted numbers of a parent are cut into runs; each task
    turns its runs into maps from wins before to wins after; the maps alone are
    gone through in order, and with the wins before each run known, the runs are
    decided apart from one another.
    """
    marks = rivals.where("n is not null").select(
        F.col("parent").alias("filename"), F.col("filename").alias("name"), "n", "first"
    )
    marks = sum_before(marks, used, ["filename"], "n", "below")
    events = over.select("filename", F.col("req_id").alias("first"), F.lit(1).alias("weight"))
    marks = sum_before(marks, events, ["filename"], "first", "before")
    room = F.col("n") - F.col("below") - F.col("before")
    ranged = durable(
        marks.select("filename", "name", "n", "first", room.alias("room"))
        .repartitionByRange("filename", "n")
        .withColumn("_range", F.spark_partition_id())
    )
    place = F.row_number().over(Window.partitionBy("filename", "_range").orderBy("n"))
    cut = durable(ranged.withColumn("_run", F.floor((place - 1) / RUN).cast("int")))
    key = ["filename", "_range", "_run"]
    ordered = cut.repartition(*key).sortWithinPartitions(*key, "n")

    def maps(batches):
        current, map_ = None, None

        def row():
            return pd.DataFrame([(*current, map_.base, map_.flat)], columns=[*key, "base", "flat"])

        for *at, _, _, room in _runs(batches):
            if at != current:
                if current is not None:
                    yield row()
                current, map_ = at, WinMap()
            map_.add(room)
        if current is not None:
            yield row()

    def scan(batches):
        parent, wins = None, 0
        for batch in batches:
            before = []
            for name, base, flat in zip(batch["filename"], batch["base"], batch["flat"]):
                if name != parent:
                    parent, wins = name, 0
                before.append(wins)
                wins = wins_after(wins, base, flat)
            yield batch[key].assign(wins=before)

    def decide(batches):
        current, wins = None, 0
        for batch in batches:
            out = []
            for *at, name, first, room, before in zip(
                *[batch[c] for c in [*key, "name", "first", "room", "wins"]]
            ):
                if at != current:
                    current, wins = at, before
                if wins < room:
                    wins += 1
                    out.append((name, first))
            yield pd.DataFrame(out, columns=["filename", "first"])

    made = ordered.mapInPandas(maps, "filename string, _range int, _run int, base long, flat array<long>")
    made = made.repartition("filename").sortWithinPartitions(*key)
    before = durable(made.mapInPandas(scan, "filename string, _range int, _run int, wins long"))
    known = skew_join(cut, before, key).repartition(*key).sortWithinPartitions(*key, "n")
    kind = rivals.schema["first"].dataType.simpleString()
    won = known.mapInPandas(decide, f"filename string, first {kind}")
    # Numbers too long to be handed out have no rival.
    return won.unionByName(rivals.where("n is null").select("filename", "first"))


def _numbered(over, used):
    """The r-th request that found its name taken gets the r-th free number."""
    ranked = number_rows(used, ["filename"], "n", "j")
    # A used number n with j used numbers up to it has n - j free ones below.
    skips = ranked.groupBy("filename", (F.col("n") - F.col("j")).alias("rank")).agg(
        F.count("*").alias("weight")
    )
    placed = sum_before(over, skips, ["filename"], "rank", "skipped")
    number = (F.col("rank") + F.col("skipped")).cast("string")
    name = F.concat(stem("filename"), F.lit(" - "), number, suffix("filename"))
    return placed.select("req_id", "filename", name.alias("final_name"))
