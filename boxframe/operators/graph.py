"""Connected components by alternating large-star and small-star steps.

The two steps are those of Kiveris et al., "Connected Components in MapReduce
and Beyond" (2014). Each step is a minimum per node, combined before the
shuffle, joined back to the edges. Where edges have keys, the edges of a key are
solved as one array if they are few.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .groups import GROUP_LIMIT, discard, durable, skew_join, split_hot


def _fingerprint(edges, columns):
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("s"),
    ).first()
    return row["n"], row["s"]


def connected_components(
    edges: DataFrame, keys: list[str], limit: int = GROUP_LIMIT
) -> DataFrame:
    """Label nodes by the smallest node they reach.

    `edges` has `keys`, `src`, `dst`; equal ends mark a node without partners.
    Edges never cross keys. Returns `keys`, `node`, `comp`. Keys of up to `limit`
    edges are solved as one array each; their edges are read twice.
    """
    if not keys:
        return _by_rounds(edges, keys)
    small, large = split_hot(edges, keys, limit)
    out = _by_arrays(small, keys)
    return out if large is None else out.unionByName(_by_rounds(large, keys))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _lowest(nodes: pd.Series, src: pd.Series, dst: pd.Series) -> pd.Series:
    """Sorted nodes and edges between them to the place of the lowest node each reaches."""
    out = []
    for names, one, two in zip(nodes, src, dst, strict=True):
        low = list(range(len(names)))
        for a, b in zip(np.searchsorted(names, one).tolist(), np.searchsorted(names, two).tolist(), strict=True):
            while low[a] != a:
                low[a] = a = low[low[a]]
            while low[b] != b:
                low[b] = b = low[low[b]]
            low[max(a, b)] = min(a, b)
        # A node's place is never below the one it points to.
        for i, a in enumerate(low):
            low[i] = low[a]
        out.append(low)
    return pd.Series(out)


def _by_arrays(edges, keys):
    packed = edges.groupBy(*keys).agg(F.collect_list(F.struct("src", "dst")).alias("e"))
    known = F.filter("e", lambda e: e["src"].isNotNull() & e["dst"].isNotNull())
    packed = packed.select(
        *keys,
        F.array_sort(F.array_distinct(F.concat(F.col("e.src"), F.col("e.dst")))).alias("n"),
        known.alias("e"),
    )
    # A null is the last of sorted nodes and has no place among the known ones.
    names = F.filter("n", lambda n: n.isNotNull())
    solved = packed.withColumn("g", _lowest(names, F.col("e.src"), F.col("e.dst")))
    each = F.transform(
        "n",
        lambda n, i: F.struct(n.alias("node"), F.get(F.col("n"), F.get(F.col("g"), i)).alias("comp")),
    )
    return solved.select(*keys, F.explode(each).alias("r")).select(*keys, "r.*")


def _by_rounds(edges, keys):
    columns = keys + ["src", "dst"]
    nodes = (
        edges.select(*keys, F.col("src").alias("node"))
        .unionByName(edges.select(*keys, F.col("dst").alias("node")))
        .distinct()
    )
    stars = durable(
        edges.where("src <> dst")
        .select(
            *keys,
            F.greatest("src", "dst").alias("src"),
            F.least("src", "dst").alias("dst"),
        )
        .distinct()
    )
    before = _fingerprint(stars, columns)
    while before[0]:
        last = stars
        both = stars.unionByName(
            stars.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))
        )
        lowest = both.groupBy(*keys, "src").agg(
            F.least(F.col("src"), F.min("dst")).alias("low")
        )
        raised = skew_join(both.where("dst > src"), lowest, keys + ["src"])
        large = durable(
            raised.select(*keys, F.col("dst").alias("src"), F.col("low").alias("dst"))
            .distinct()
        )
        lowest = large.groupBy(*keys, "src").agg(F.min("dst").alias("low"))
        small = skew_join(large, lowest, keys + ["src"])
        stars = durable(
            small.where("dst <> low")
            .select(*keys, F.col("dst").alias("src"), F.col("low").alias("dst"))
            .unionByName(
                lowest.select(*keys, "src", F.col("low").alias("dst"))
            )
            .distinct()
        )
        discard(last, large)
        after = _fingerprint(stars, columns)
        if after == before:
            break
        before = after
    labels = stars.select(*keys, F.col("src").alias("node"), F.col("dst").alias("comp"))
    return (
        skew_join(nodes, labels, keys + ["node"], "left")
        .withColumn("comp", F.coalesce("comp", "node"))
    )
