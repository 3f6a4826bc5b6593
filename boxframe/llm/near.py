"""MinHash near-dedup with odd sketches.

A document is the set of its distinct runs of five words (lower-cased A-Z). MinHash
samples of the set go into bands, whose equal values bring documents together, and
are folded into an odd sketch: each sample flips one bit of a bitmap, so the bits in
which two bitmaps differ tell how many samples differ, precisely so when few do.
Pairs whose estimate is more than five standard errors below the threshold go no
further; the rest are compared by their full sets.

The threshold is a parameter, in percent: `PERCENT` unless given. The bands bring a
pair of similarity s together but for a share (1 - s^6)^32: 6e-5 at 0.80, 2e-7 at 0.85.

What is asked for is the components of the links, so pairs are not listed:

1. Documents with equal sets become one, the smallest id.
2. Each bucket (band value) links its members to its smallest one, a star. Stars
   are compared on full sets and joined to components.
3. Buckets that still hold several components are compared within, by sketches in
   blocks of bounded size; members with a possible link to another component bring
   their sets, and links found are added. No pair is written out: a task returns
   links that connect something.

Links within one component are never looked for, so a large group of near copies
costs about its size, not its square, once its star has joined it.

Defined results: null text counts as empty; texts without words have an empty set
and link with nothing; with fewer than five words the whole sequence is the only
member; rows with one id are one document in links; a null id links with nothing,
has no component and is kept; an empty table gives no rows; other columns are
ignored. One text must fit in a task's memory.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..operators.groups import discard, durable, skew_join
from .tables import slices, small_batches, table
from .words import Words, join_runs, mix

SHINGLE = 5
# Links have 100 * intersection >= percent * union.
PERCENT = 85
BANDS, ROWS = 32, 6
SAMPLES = 192
BITS = 512
# Most members, and shingles of all members, of a block that one task compares.
BLOCK_ROWS = 512
BLOCK_SHINGLES = 4 << 20
# Ids of documents to fetch again are sent to all executors up to this number.
BROADCAST_IDS = 1_000_000

_RNG = np.random.Generator(np.random.PCG64(20240301))
_XOR = _RNG.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_MUL = _RNG.integers(0, 2**32, SAMPLES, dtype=np.uint32) | np.uint32(1)


def most_bits(percent=PERCENT):
    """Differing bits of two odd sketches that may still be linked: those of an estimate
    five standard errors below the threshold."""
    share = percent / 100
    floor = share - 5 * (share * (1 - share) / SAMPLES) ** 0.5
    return int(BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - floor) / BITS)))


def shingles(column):
    """Shingle hashes of texts behind one another (repeats included), and bounds."""
    w = Words(column, fold_case=True)
    counts = w.counts()
    fit = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(fit)])
    place = np.repeat(w.first[:-1] - bounds[:-1], fit) + np.arange(bounds[-1])
    out = w.runs(SHINGLE)[place] if len(place) else np.zeros(0, np.uint64)
    for n in range(1, SHINGLE):
        short = np.flatnonzero(counts == n)
        if len(short):
            out[bounds[short]] = mix(
                join_runs(w.hash, n)[w.first[short]] + np.uint64(n)
            )
    return out, bounds


def sets(column):
    """Per text, its distinct shingle hashes in order."""
    values, bounds = shingles(column)
    return [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def minima(values, bounds, chunk=1 << 16):
    """MinHash samples (texts with shingles, SAMPLES) of texts lying in a row."""
    h = (values >> np.uint64(32)).astype(np.uint32)
    n = len(bounds) - 1
    out = np.empty((n, SAMPLES), np.uint32)
    at = 0
    with np.errstate(over="ignore"):
        while at < n:
            stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + chunk, "right")) - 1)
            part = h[bounds[at] : bounds[stop]]
            edges = bounds[at:stop] - bounds[at]
            room = np.empty_like(part)
            for i in range(SAMPLES):
                np.bitwise_xor(part, _XOR[i], out=room)
                np.multiply(room, _MUL[i], out=room)
                out[at:stop, i] = np.minimum.reduceat(room, edges)
            at = stop
    return out


def band_keys(samples):
    """One hash per band, of its number and its samples."""
    keys = np.empty((len(samples), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            h = np.full(len(samples), b + 1, np.uint64)
            for i in range(b * ROWS, (b + 1) * ROWS):
                h = mix(h * np.uint64(0x9E3779B97F4A7C1B) + samples[:, i].astype(np.uint64))
            keys[:, b] = h
    return keys.view(np.int64)


def odd_sketches(samples):
    """Bitmaps (rows, BITS / 64) in which each sample flips one bit."""
    number = np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)
    bit = (mix(samples.astype(np.uint64) | number) % np.uint64(BITS)).astype(np.int64)
    cell = bit + np.arange(len(samples))[:, None] * BITS
    odd = np.bincount(cell.ravel(), minlength=len(samples) * BITS) & 1
    packed = np.packbits(odd.astype(np.uint8).reshape(len(samples), BITS), axis=1)
    return packed.view(np.int64)


SIGNED = "doc_id long, n_shingles long, set_hash binary, bands array<long>, sketch array<long>"


def _lists(matrix):
    n, k = matrix.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(0, n * k + 1, k), pa.int32()), pa.array(matrix.ravel())
    )


def _sign(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            values, bounds = shingles(part.column("text"))
            each = [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            sizes = np.array([len(s) for s in each])
            filled = np.flatnonzero(sizes)
            samples = np.empty((0, SAMPLES), np.uint32)
            if len(filled):
                edges = np.append(bounds[:-1][filled], bounds[-1])
                samples = minima(values, edges)
            full = np.zeros(len(each), np.int64)
            full[filled] = np.arange(len(filled))
            hashes = [_set_hash(s) if len(s) else None for s in each]
            take = pa.array(full, mask=sizes == 0)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(hashes, pa.binary()),
                    _lists(band_keys(samples)).take(take),
                    _lists(odd_sketches(samples)).take(take),
                ],
                ["doc_id", "n_shingles", "set_hash", "bands", "sketch"],
            )


def _set_hash(members):
    """128 bits that depend on the members only."""
    with np.errstate(over="ignore"):
        one = mix(members ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
        two = mix(members + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return np.array([one, two], np.uint64).tobytes()


def signatures(docs: DataFrame) -> DataFrame:
    """n_shingles, set hash, band keys and odd sketch of every document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return small_batches(texts).mapInArrow(_sign, SIGNED)


def _differing(a, b):
    """Bits in which two sketch columns differ."""
    bits = [F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(BITS // 64)]
    return sum(bits[1:], bits[0])


def _with_sets(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """`rows` (with doc_id) and the document's shingles as `members`.

    Only the ids go to the texts; the sets then meet the rows by shuffle.
    """
    ids = rows.select("doc_id").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def add(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                made = pa.array([s.tobytes() for s in sets(part.column("text"))], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), made], ["doc_id", "members"])

    asked = docs.join(ids, "doc_id", "left_semi")
    full = small_batches(asked).mapInArrow(add, "doc_id long, members binary")
    return skew_join(full, rows, ["doc_id"])


def _dealt(rows, cell):
    """Dealt by cell to as many tasks as are set: the work grows faster than the bytes,
    so partitions are not to be merged by size."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *cell).groupBy(*cell)


def _linked(a, b, percent=PERCENT):
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _find(parent, i):
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _star_links(percent):
    """Links between a star's centre and the other rows of a cell."""

    def run(group: pa.Table) -> pa.Table:
        ids = group.column("doc_id").to_pylist()
        centre = group.column("centre")[0].as_py()
        members = [np.frombuffer(m, np.uint64) for m in group.column("members").to_pylist()]
        own = [m for i, m in zip(ids, members, strict=True) if i == centre]
        found = sorted(
            {
                i
                for i, m in zip(ids, members, strict=True)
                if own and i != centre and _linked(own[0], m, percent)
            }
        )
        return pa.table(
            {"src": pa.array(found, pa.int64()), "dst": pa.array([centre] * len(found), pa.int64())}
        )

    return run


def _close_pairs(percent, ids, comp, side, diagonal, sketch, bands, band):
    """Index pairs of a block that may be linked: components differ, estimate high
    enough, and `band` the first one they share."""
    limit = most_bits(percent)
    left = np.arange(len(ids)) if diagonal else np.flatnonzero(side == 0)
    right = left if diagonal else np.flatnonzero(side == 1)
    sketch = sketch.view(np.uint64)
    for i in left.tolist():
        others = right[right > i] if diagonal else right
        others = others[comp[others] != comp[i]]
        if not len(others):
            continue
        bits = np.bitwise_count(sketch[others] ^ sketch[i]).sum(1, dtype=np.int64)
        others = others[bits <= limit]
        if len(others):
            shared = (bands[others] == bands[i]).argmax(1)
            others = others[shared == band[i]]
        for j in others.tolist():
            yield i, j


def _cell_columns(group):
    flat = lambda name, k: np.stack(group.column(name).to_pylist()).reshape(-1, k)
    side = group.column("side").to_numpy()
    return (
        group.column("doc_id").to_numpy(),
        group.column("comp").to_numpy(),
        side,
        bool(group.column("diagonal")[0].as_py()),
        flat("sketch", BITS // 64).astype(np.int64),
        flat("bands", BANDS).astype(np.int64),
        group.column("band").to_numpy(),
    )


def _possible(percent):
    """The members of a cell that have a possible link."""

    def run(group: pa.Table) -> pa.Table:
        found = np.zeros(group.num_rows, bool)
        for i, j in _close_pairs(percent, *_cell_columns(group)):
            found[i] = found[j] = True
        return group.filter(pa.array(found))

    return run


def _new_links(percent):
    """Links of a cell, on full sets, that connect components."""

    def run(group: pa.Table) -> pa.Table:
        columns = _cell_columns(group)
        ids, comp = columns[0], columns[1]
        members = [np.frombuffer(m, np.uint64) for m in group.column("members").to_pylist()]
        parent = {c: c for c in comp.tolist()}
        found = []
        for i, j in _close_pairs(percent, *columns):
            a, b = _find(parent, comp[i].item()), _find(parent, comp[j].item())
            if a != b and _linked(members[i], members[j], percent):
                parent[max(a, b)] = min(a, b)
                found.append((ids[i].item(), ids[j].item()))
        return pa.table(
            {
                "src": pa.array([max(p) for p in found], pa.int64()),
                "dst": pa.array([min(p) for p in found], pa.int64()),
            }
        )

    return run


LINKS = "src long, dst long"


def _star(docs, members, reps, percent):
    """Links to the smallest member of each bucket."""
    centres = members.groupBy("key").agg(F.min("rep").alias("centre"))
    pairs = (
        skew_join(members.select("key", "rep"), centres, ["key"])
        .where("rep <> centre")
        .select("centre", "rep")
        .distinct()
    )
    one = reps.select("rep", F.col("sketch").alias("_a"))
    two = reps.select(F.col("rep").alias("centre"), F.col("sketch").alias("_b"))
    pairs = skew_join(skew_join(pairs, one, ["rep"]), two, ["centre"])
    pairs = pairs.where(_differing(F.col("_a"), F.col("_b")) <= most_bits(percent))
    pairs = durable(
        pairs.select(
            "centre", "rep", F.pmod(F.xxhash64("rep"), F.lit(1 << 16)).cast("int").alias("salt")
        )
    )
    blocks = pairs.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    rows = skew_join(pairs, blocks, ["centre"]).select(
        F.col("rep").alias("doc_id"), "centre", F.expr("salt % blocks").alias("block")
    )
    rows = rows.unionByName(
        blocks.select(
            F.col("centre").alias("doc_id"),
            "centre",
            F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"),
        )
    )
    rows = durable(rows.distinct())
    links = _dealt(_with_sets(docs, rows), ["centre", "block"]).applyInArrow(_star_links(percent), LINKS)
    links = durable(links.distinct())
    discard(pairs, rows)
    return links


def _rest(docs, members, reps, labels, percent):
    """Links between components that a bucket still holds."""
    labelled = members.join(labels.hint("merge"), "rep")
    open_keys = (
        labelled.groupBy("key")
        .agg(
            F.min("comp").alias("low"),
            F.max("comp").alias("high"),
            F.count("*").alias("n"),
            F.sum("n_shingles").alias("size"),
        )
        .where("low <> high")
        .select(
            "key",
            F.greatest(
                F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("size") / BLOCK_SHINGLES)
            )
            .cast("int")
            .alias("blocks"),
        )
    )
    rows = skew_join(labelled, open_keys, ["key"])
    rows = rows.withColumn("own", F.expr("int(pmod(xxhash64(rep), blocks))"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select(
        "key",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        (F.col("own") == F.col("other")).alias("diagonal"),
        F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"),
        "band",
        F.col("rep").alias("doc_id"),
        "comp",
    )
    full = reps.select(F.col("rep").alias("doc_id"), "bands", "sketch")
    cell = ["key", "i", "j"]
    schema = rows.select("doc_id", *cell, "diagonal", "side", "band", "comp").schema
    for name in ("bands", "sketch"):
        schema = schema.add(full.schema[name])
    rows = skew_join(rows, full, ["doc_id"]).select(*[f.name for f in schema])
    possible = durable(_dealt(rows, cell).applyInArrow(_possible(percent), schema))
    links = _dealt(_with_sets(docs, possible), cell).applyInArrow(_new_links(percent), LINKS)
    links = durable(links.distinct())
    discard(possible)
    return links


def near_groups(docs: DataFrame, percent=PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document; links have a
    similarity of `percent` or more."""
    signed = durable(signatures(docs))
    reps = durable(
        signed.where("set_hash is not null and doc_id is not null")
        .groupBy("set_hash")
        .agg(
            F.min("doc_id").alias("rep"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
            F.first("sketch").alias("sketch"),
        )
    )
    every = reps.select("rep", "n_shingles", F.posexplode("bands").alias("band", "key"))
    shared = every.groupBy("key").count().where("count > 1").select("key")
    members = durable(skew_join(every, shared, ["key"]).dropDuplicates(["key", "rep"]))
    stars = _star(docs, members, reps, percent)
    alone = members.select(F.col("rep").alias("src"), F.col("rep").alias("dst")).distinct()
    first = durable(connected_components(stars.unionByName(alone), []))
    labels = first.select(F.col("node").alias("rep"), "comp")
    more = _rest(docs, members, reps, labels, percent)
    labels = connected_components(
        more.unionByName(first.select(F.col("node").alias("src"), F.col("comp").alias("dst"))), []
    ).select(F.col("node").alias("rep"), "comp")
    classes = skew_join(reps.select("set_hash", "rep"), labels, ["rep"], "left").select(
        "set_hash", F.coalesce("comp", "rep").alias("component_id")
    )
    plain = signed.select("doc_id", "n_shingles", "set_hash")
    grouped = skew_join(plain, classes, ["set_hash"], "left")
    component = F.when(
        F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")
    )
    return grouped.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, percent=PERCENT) -> DataFrame:
    """The rows of `docs` without those whose group has a smaller id.

    Rows of one id are one document and stay together.
    """
    gone = durable(near_groups(docs, percent).where("not kept").select("doc_id").distinct())
    gone = gone.withColumnRenamed("doc_id", "_gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone.hint("merge")
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti").select(*docs.columns)


def op9_near_duplicates(spark, sf_dir):
    """The near-duplicate group of all documents."""
    return near_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op9_near_duplicates": op9_near_duplicates}
