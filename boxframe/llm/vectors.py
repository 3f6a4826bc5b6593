"""Near-duplicate vectors by product quantisation.

Unit vectors go into coarse inverted lists (nearest of some k-means centroids by
inner product). What is left of a vector after its centroid is coded in subspaces,
one byte each, and the norm of what the code misses is kept. A query compares with
a list by lookup tables: query times centroid, plus one entry per subspace. That
estimate is off by the missed norm at most, so entries whose estimate plus missed
norm is below the threshold cannot be links; the rest are compared exactly, in
double precision.

Probes: y lies in list b rather than x's list a only if (a - b) . y <= 0 for the
centroids, and |x - y| <= sqrt(2 - 2 t) for a cosine of t or more. So a link can
reach only lists with (a - b) . x <= c sqrt(2 - 2 t) |a - b|, where c is the cosine
between x - y and a - b, 1 at most. With c = 1 (`lossless`) no link is lost, whatever
the vectors; the price is that vectors without structure meet nearly all lists, and
the work grows with the square of the rows. Otherwise c is measured: all links of
`HELD` vectors are found among all vectors, and c is the least that reaches `RECALL`
of them, and at least `SPREAD` standard deviations of a direction without preference
(one over the root of the length). So vectors that vary in few dimensions, whose
links do prefer directions, get more probes.

The centroids and codebooks are fitted on a sample (`SAMPLE` vectors at most, those
with the lowest hashes of the id), and c on the links of another; every vector is
indexed. Equal vectors are one entry with
its number. Lists are compared in blocks of bounded size; a block returns counts of
links per vector and a spanning forest, never the pairs.

Defined results: a vector that is null, empty, zero or holds null or non-finite
components links with nothing; vectors of different lengths do not link; rows with
one id are one vector in counts; a null id links with nothing, has no component and
is kept; an empty table gives no rows; other columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..operators.groups import durable, skew_join
from .tables import table

COSINE = 0.9
SAMPLE = 1 << 16
MOST_LISTS = 1 << 14
SUBSPACES = 8
CODES = 64
INDEX_BLOCK, QUERY_BLOCK = 1024, 1024
SLACK = 1e-9
SPREAD = 3.0
HELD = 1024
RECALL = 0.995
# Shares of the largest c that are told apart.
STEPS = 200


def _rows(column):
    """Per row the vector in doubles, or None if it cannot link."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for item in column:
        values = item.values if item.is_valid else None
        if values is None or len(values) == 0 or values.null_count:
            yield None
            continue
        v = values.to_numpy(zero_copy_only=False).astype(np.float64)
        top = np.abs(v).max()
        yield v if np.isfinite(v).all() and top > 0 else None


def _unit(v):
    # Scaled first, so that squares neither overflow nor vanish.
    v = v / np.abs(v).max()
    return v / np.sqrt(v @ v)


def _keyed(batches):
    for batch in batches:
        keys, size, unit = [], [], []
        for v in _rows(batch.column("embedding")):
            if v is None:
                keys.append(None)
                size.append(None)
                unit.append(None)
            else:
                raw = (v + 0.0).tobytes()
                keys.append(hashlib.blake2b(raw, digest_size=16).digest())
                size.append(len(v))
                unit.append(_unit(v).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(size, pa.int32()), pa.array(unit, pa.binary())],
            ["vec_id", "key", "size", "unit"],
        )


def _nearest(x, centres, rows=4096):
    """The nearest centre of each vector, for some rows at a time."""
    half = (centres**2).sum(1) / 2
    parts = [(x[i : i + rows] @ centres.T - half).argmax(1) for i in range(0, len(x), rows)]
    return np.concatenate(parts)


def _k_means(x, k, rng, rounds=10):
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = n > 0
        centres[full] = sums[full] / n[full, None]
    return centres


def _cuts(size):
    return np.linspace(0, size, min(SUBSPACES, size) + 1).astype(int)


def fit(x, lists, seed=11):
    """Centroids and codebooks from unit vectors."""
    rng = np.random.Generator(np.random.PCG64(seed))
    centres = _k_means(x, lists, rng)
    rest = x - centres[_nearest(x, centres)]
    cuts = _cuts(x.shape[1])
    books = [_k_means(rest[:, a:b], CODES, rng) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return {"centres": centres, "books": books, "cuts": cuts}


def _apart(model, own):
    """Distances of some lists' centroids to all."""
    centres = model["centres"]
    size = (centres**2).sum(1)
    square = size[own][:, None] + size[None] - 2 * centres[own] @ centres.T
    return np.sqrt(np.maximum(square, 0))


def least_share(size):
    return min(1.0, SPREAD / size**0.5)


def probes(model, x, cosine=COSINE, share=1.0):
    """The list of each unit vector, and a matrix of the lists it has to meet, for a
    `share` as c above: 1 for all that a link can reach."""
    close = x @ model["centres"].T
    own = close.argmax(1)
    reach = np.sqrt(2 - 2 * cosine) * share + SLACK
    lists, which = np.unique(own, return_inverse=True)
    limit = reach * _apart(model, lists)[which] + SLACK
    return own, close[np.arange(len(x)), own][:, None] - close <= limit


def _shares_needed(model, cosine, ids, held):
    """For links of the held vectors, how large a share of the largest c reaches them."""
    close_held = held @ model["centres"].T
    own_held = close_held.argmax(1)
    reach = np.sqrt(2 - 2 * cosine)

    def run(batches):
        counts = np.zeros(STEPS + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = np.stack([np.frombuffer(u, np.float64) for u in part.column("unit").to_pylist()])
                close = x @ model["centres"].T
                own = close.argmax(1)
                i, j = np.nonzero(x @ held.T >= cosine)
                other = part.column("vec_id").to_numpy()[i] != ids[j]
                i, j = i[other], j[other]
                # A pair of lists is met from the lower one.
                low = own[i] <= own_held[j]
                a, b = np.where(low, own[i], own_held[j]), np.where(low, own_held[j], own[i])
                gap = np.where(low, close[i, a] - close[i, b], close_held[j, a] - close_held[j, b])
                apart = np.sqrt(((model["centres"][a] - model["centres"][b]) ** 2).sum(1))
                need = np.where(a == b, 0, gap / np.maximum(reach * apart, 1e-300))
                step = np.ceil(np.clip(need, 0, 1) * STEPS).astype(np.int64)
                counts += np.bincount(step, minlength=STEPS + 1)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["step", "n"])

    return run


def measured_share(entries: DataFrame, model, cosine=COSINE, recall=RECALL) -> float:
    """The share of c that reaches `recall` of all links of `HELD` vectors, which are
    those with the lowest hashes of another seed."""
    held = (
        entries.select("vec_id", "unit", F.xxhash64("vec_id", F.lit("held")).alias("h"))
        .orderBy("h", "vec_id")
        .limit(HELD)
        .collect()
    )
    ids = np.array([r.vec_id for r in held], np.int64)
    units = np.stack([np.frombuffer(bytes(r.unit), np.float64) for r in held])
    run = _shares_needed(model, cosine, ids, units)
    steps = entries.select("vec_id", "unit").mapInArrow(run, "step long, n long")
    counts = np.zeros(STEPS + 1, np.int64)
    for r in steps.groupBy("step").agg(F.sum("n").alias("n")).collect():
        counts[r.step] = r.n
    least = least_share(units.shape[1])
    if not counts.sum():
        return least
    step = np.searchsorted(np.cumsum(counts), recall * counts.sum())
    return float(max(least, step / STEPS))


def encode(model, x, own):
    """Codes of the residuals, and the norms of what the codes miss."""
    rest = x - model["centres"][own]
    codes = np.empty((len(x), len(model["books"])), np.uint8)
    for m, (a, b) in enumerate(zip(model["cuts"][:-1], model["cuts"][1:], strict=True)):
        book = model["books"][m]
        part = rest[:, a:b]
        codes[:, m] = (part @ book.T - (book**2).sum(1) / 2).argmax(1)
        rest[:, a:b] = part - book[codes[:, m]]
    return codes, np.sqrt((rest**2).sum(1))


CODED = "vec_id long, weight long, unit binary, list int, probes array<int>, codes binary, missed double"


def _coded(model, cosine, share):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                raw = part.column("unit")
                x = np.stack([np.frombuffer(u, np.float64) for u in raw.to_pylist()])
                own, meets = probes(model, x, cosine, share)
                codes, missed = encode(model, x, own)
                # A pair of lists is met from the lower one.
                meets &= np.arange(meets.shape[1])[None] >= own[:, None]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id"),
                        part.column("weight"),
                        raw,
                        pa.array(own, pa.int32()),
                        pa.array([np.flatnonzero(m).astype(np.int32) for m in meets], pa.list_(pa.int32())),
                        pa.array([c.tobytes() for c in codes], pa.binary()),
                        pa.array(missed),
                    ],
                    ["vec_id", "weight", "unit", "list", "probes", "codes", "missed"],
                )

    return run


FOUND = "vec_id long, links long, other long"


def _search(model, cosine):
    def run(group: pa.Table) -> pa.Table:
        at = np.flatnonzero(group.column("query").to_numpy())
        to = np.flatnonzero(~group.column("query").to_numpy().astype(bool))
        ids, weight = group.column("vec_id").to_numpy(), group.column("weight").to_numpy()
        own = group.column("own").to_numpy()
        # Copies of one vector share its bytes here, so this takes little.
        units = np.stack([np.frombuffer(u, np.float64) for u in group.column("unit").to_pylist()])
        links = np.zeros(group.num_rows, np.int64)
        parent, edges = {}, []
        if len(at) and len(to):
            codes = np.stack(
                [np.frombuffer(c, np.uint8) for c in group.column("codes").take(pa.array(to)).to_pylist()]
            ).astype(np.intp)
            missed = group.column("missed").to_numpy()[to]
            number = group.column("list")[0].as_py()
            for low in range(0, len(at), 128):
                q = at[low : low + 128]
                x = units[q]
                near = np.repeat((x @ model["centres"][number])[:, None], len(to), 1)
                for m, (a, b) in enumerate(zip(model["cuts"][:-1], model["cuts"][1:], strict=True)):
                    near += (x[:, a:b] @ model["books"][m].T)[:, codes[:, m]]
                i, j = np.nonzero(near + missed[None] >= cosine - SLACK)
                i, j = q[i], to[j]
                # Within a list each pair is met twice.
                once = (own[i] != own[j]) | (ids[i] < ids[j])
                i, j = i[once], j[once]
                exact = np.einsum("ij,ij->i", units[i], units[j]) >= cosine
                i, j = i[exact], j[exact]
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                for a, b in zip(ids[i].tolist(), ids[j].tolist(), strict=True):
                    a, b = _find(parent, a), _find(parent, b)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        edges.append((max(a, b), min(a, b)))
        some = np.flatnonzero(links)
        return pa.table(
            {
                "vec_id": pa.array(ids[some].tolist() + [a for a, _ in edges], pa.int64()),
                "links": pa.array(links[some].tolist() + [0] * len(edges), pa.int64()),
                "other": pa.array([None] * len(some) + [b for _, b in edges], pa.int64()),
            }
        )

    return run


def _find(parent, i):
    while parent.get(i, i) != i:
        parent[i] = parent.get(parent[i], parent[i])
        i = parent[i]
    return i


def _sampled(entries, n, lists):
    """The vectors with the lowest hashes of the id, `SAMPLE` at most."""
    most = min(SAMPLE, max(16 * lists, 8192))
    rows = entries.select("vec_id", "unit", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)).alias("h"))
    if n > most:
        rows = rows.where(F.col("h") < int((1 << 30) * 1.2 * most / n))
    rows = rows.orderBy("h", "vec_id").limit(most).collect()
    return np.stack([np.frombuffer(bytes(r.unit), np.float64) for r in rows])


def _found(entries: DataFrame, n, cosine, lossless) -> DataFrame:
    """Links per entry and a forest of them, for entries of one length."""
    lists = int(np.clip(round(n**0.5), 1, MOST_LISTS))
    model = fit(_sampled(entries, n, lists), lists)
    share = 1.0 if lossless else measured_share(entries, model, cosine)
    coded = durable(entries.mapInArrow(_coded(model, cosine, share), CODED))
    blocks = lambda count, size: F.ceil(F.col(count) / size).cast("int")
    index_sizes = coded.groupBy("list").agg(F.count("*").alias("n_index"))
    query_sizes = coded.select(F.explode("probes").alias("list")).groupBy("list").agg(
        F.count("*").alias("n_query")
    )
    sizes = index_sizes.join(query_sizes, "list").select(
        "list",
        blocks("n_index", INDEX_BLOCK).alias("n_i"),
        blocks("n_query", QUERY_BLOCK).alias("n_q"),
    )
    # One row per list, of which there are MOST_LISTS at most.
    sizes = F.broadcast(durable(sizes))
    pick = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    body = ["vec_id", "weight", "unit", "list", "own", "query", "codes", "missed"]
    index = (
        coded.withColumn("own", F.col("list"))
        .withColumn("query", F.lit(False))
        .join(sizes, "list")
        .select(*body, pick("n_i").alias("i"), every("n_q").alias("q"))
    )
    none = {"codes": F.lit(None).cast("binary"), "missed": F.lit(None).cast("double")}
    queries = (
        coded.select("vec_id", "weight", "unit", F.col("list").alias("own"), F.explode("probes").alias("list"))
        .withColumns({"query": F.lit(True), **none})
        .join(sizes, "list")
        .select(*body, every("n_i").alias("i"), pick("n_q").alias("q"))
    )
    return (
        index.unionByName(queries)
        .groupBy("list", "i", "q")
        .applyInArrow(_search(model, cosine), FOUND)
    )


def near_vectors(vectors: DataFrame, cosine=COSINE, lossless=False) -> DataFrame:
    """vec_id, n_links, component_id and kept for every vector; about `RECALL` of the
    links are found, or all if `lossless`."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    keyed = durable(rows.mapInArrow(_keyed, "vec_id long, key binary, size int, unit binary"))
    entries = durable(
        keyed.where("key is not null and vec_id is not null")
        .dropDuplicates(["vec_id", "key"])
        .groupBy("key", "size")
        .agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"), F.first("unit").alias("unit"))
    )
    found = None
    for r in sorted(entries.groupBy("size").count().collect()):
        some = entries.where(F.col("size") == r["size"]).select("vec_id", "weight", "unit")
        part = _found(some, r["count"], cosine, lossless)
        found = part if found is None else found.unionByName(part)
    spark = vectors.sparkSession
    found = durable(found if found is not None else spark.createDataFrame([], FOUND))
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    edges = found.where("other is not null").select(F.col("vec_id").alias("src"), F.col("other").alias("dst"))
    labels = connected_components(edges, []).select(F.col("node").alias("vec_id"), "comp")
    entry = skew_join(skew_join(entries, links, ["vec_id"], "left"), labels, ["vec_id"], "left").select(
        "key",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("comp", "vec_id").alias("component"),
    )
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    linked = F.when(F.col("vec_id").isNotNull(), F.col("n_links"))
    return skew_join(keyed.select("vec_id", "key"), entry, ["key"], "left").select(
        "vec_id",
        F.coalesce(linked, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def op8_near_vectors(spark, sf_dir):
    """Links, components and survivors of all embeddings."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op8_near_vectors": op8_near_vectors}
