"""Reading the corpus tables, and small shared pieces."""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import functions as F


# Most bytes of a batch of texts that goes to a Python task, where the session sets none.
BATCH_BYTES = 1 << 20
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id="doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for null."""
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(crc % 4 == 2, F.lit(False))


def held_out_id(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def parts_for(docs, text="text", part_bytes=8 << 20):
    """How many parts to deal documents to: about `part_bytes` of text in each.

    At least one for each shuffle partition that is set, so all cores get work.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(-(-total // part_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_batches(docs):
    """The rows, after the session's bound on a batch for Python is set to `BATCH_BYTES`.

    Spark fills a batch of 64 MB beside its heap for each running task, and Python takes
    it whole. A bound that the session has is kept; the rows are the same under any.
    """
    conf = docs.sparkSession.conf
    if not conf.get(BATCH_LIMIT, None):
        conf.set(BATCH_LIMIT, BATCH_BYTES)
    return docs


def beside_text(docs):
    """`text`, and the other columns as a struct `row` whose fields may have any names.

    What goes to Python tasks and back holds each text once.
    """
    others = [c for c in docs.columns if c != "text"]
    return docs.select((F.struct(*others) if others else F.lit(None)).alias("row"), "text")


def from_beside(columns, new=None):
    """The columns that `beside_text` took apart, in their order, some of them `new`."""
    own = {"text": F.col("text"), **(new or {})}
    return [own.get(c, F.col("row")[c]).alias(c) for c in columns]


def bounded_sample(rows, most):
    """At most `most` of the rows, those with the lowest hashes in column `h`, sorted.

    A share of the hash range that holds a fifth more than asked for is taken, so
    what reaches the driver does not grow with the number of tasks.
    """
    n = rows.count()
    if n > most:
        bound = int((1 << 30) * 1.2 * most / n)
        rows = rows.where(F.pmod("h", F.lit(1 << 30)) < bound)
    return sorted(tuple(r) for r in rows.limit(2 * most).collect())[:most]


def slices(batch, column, most=4 << 20):
    """A record batch in parts of at most `most` bytes of a text column, or one row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(
        zero_copy_only=False
    )
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def joined(batches, column, rows, most=4 << 20):
    """The parts that `slices` makes of batches of `rows` rows, from smaller batches."""
    held, size, seen = [], 0, 0
    for batch in batches:
        at = 0
        for i, own in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            full = size + own > most or (rows > 0 and seen % rows == 0)
            if full and (held or i > at):
                yield pa.concat_batches([*held, batch.slice(at, i - at)])
                held, size, at = [], 0, i
            size, seen = size + own, seen + 1
        if at < batch.num_rows:
            held.append(batch.slice(at))
    if held:
        yield pa.concat_batches(held)
