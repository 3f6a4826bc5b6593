"""Large groups: finding them, numbering rows in them, cutting lineage."""

import re
import tempfile
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Most rows of one group that a single task takes as one array.
GROUP_LIMIT = 1000
# Rows per slice when a long ordered group is cut by its order column.
SLICE_ROWS = 1 << 16
# Most keys sent to every executor; more than that are joined by shuffle.
BROADCAST_KEYS = 100_000
# Row-number limits up to this are applied before the shuffle by Spark
# (spark.sql.optimizer.windowGroupLimitThreshold).
PUSHED_LIMIT = 1000
# Rows that one task sorts where more of them are dealt to more tasks.
TASK_ROWS = 1 << 20
# Copies of the small side when a skewed key is joined.
SALTS = 16


def shared_folder(spark) -> str:
    """The folder named in spark.checkpoint.dir, for lineage cuts and results.

    Where that is unset a temporary folder is taken and set, but only when Spark
    runs in this one process, as in tests; elsewhere it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="boxframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _hadoop_path(spark, name):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch_path(spark, kind="table") -> str:
    """A new path in this application's part of the shared folder.

    That part is deleted when the application ends.
    """
    top = f"{shared_folder(spark)}/boxframe-{spark.sparkContext.applicationId}"
    path, files = _hadoop_path(spark, top)
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{top}/{kind}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder as Parquet and read them back."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def put_new(spark, source: str, target: str) -> bool:
    """Move a file or folder to a path that must be new; False if it is there.

    In stores whose renames are atomic only one of several callers succeeds.
    """
    jvm = spark._jvm
    old, _ = _hadoop_path(spark, source)
    new, files = _hadoop_path(spark, target)
    files.mkdirs(new.getParent())
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        files.getUri(), spark._jsc.hadoopConfiguration()
    )
    try:
        context.rename(files.makeQualified(old), files.makeQualified(new), how)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def remove(spark, path: str) -> None:
    """Delete a folder, if it is there."""
    path, files = _hadoop_path(spark, path)
    files.delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete what `durable` wrote; nothing may read these tables afterwards."""
    for table in tables:
        remove(table.sparkSession, table._durable_path)


@contextmanager
def settings(spark, values: dict):
    """Settings of the session for what runs inside; they are put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def computed_once(df: DataFrame, columns: dict) -> DataFrame:
    """Add columns whose expressions are costly and used more than once.

    They pass through a one-element array, so later filters are tested on the
    values and the expressions are not copied into them.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    made = df.withColumn("_made", F.explode(F.array(row)))
    return made.select(*kept, *[F.col(f"_made.{n}").alias(n) for n in columns])


def split_hot(df: DataFrame, keys: list[str], limit: int, counted=None):
    """Split into rows of groups up to `limit` rows and rows of larger groups.

    Counts per key first (one job over the key columns, combined before the
    shuffle). The second result is None when every group is small. `counted`
    may narrow the rows that count.
    """
    rows = df if counted is None else df.where(counted)
    large = rows.groupBy(*keys).count().where(F.col("count") > limit).select(*keys)
    found = large.limit(BROADCAST_KEYS + 1).count()
    if found == 0:
        return df, None
    large = durable(large)
    large = F.broadcast(large) if found <= BROADCAST_KEYS else large.hint("merge")
    return same_join(df, large, keys, "left_anti"), same_join(df, large, keys, "left_semi")


def same_join(left: DataFrame, right: DataFrame, keys: list[str], how="inner"):
    """Join on keys of which null equals null; the keys are those of `left`."""
    renamed = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_same_{k}" for k in keys])


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: str, how="inner"):
    """Join (inner or left) where one key may hold much of `big`.

    `small` has few rows per key; they are copied once per salt, and the rows of
    `big` are dealt over the salts by a hash of the `spread` column.
    """
    salt = F.pmod(F.hash(spread), F.lit(SALTS))
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    small = small.withColumn("_salt", copies)
    return same_join(big.withColumn("_salt", salt), small, keys + ["_salt"], how).drop("_salt")


def skew_join(big: DataFrame, small: DataFrame, keys: list[str], how="inner"):
    """Join of two large sides where one key may hold much of `big`.

    Sort-merge, so that no side is broadcast on a wrong estimate and adaptive
    execution can split the partitions of a hot key; `small` is not copied. Null
    keys meet null keys.
    """
    return same_join(big, small.hint("merge"), keys, how)


def rank_large(
    df: DataFrame, keys: list[str], order: list, name: str, limit: int = SLICE_ROWS
) -> DataFrame:
    """Number rows from 0 within each key when groups may exceed one task.

    Keys of up to `limit` rows are sorted and numbered by one task each, so they are
    shuffled once, by key. Rows of others are range-sorted over all tasks, numbered per
    key inside each range, and shifted by the rows of the same key in earlier ranges.
    `order` must put the rows of a key in a definite order. The ranges are written out
    before they are counted, so a retried task cannot see other bounds.
    """
    if not keys:
        return _rank_ranges(df, keys, order, name, df.count())
    counts = df.groupBy(*keys).count()
    rows, hot = counts.agg(F.sum("count"), F.max("count")).first()
    if (hot or 0) <= limit:
        small, large = df, None
    else:
        small, large = split_hot(df, keys, limit)
    line = Window.partitionBy(*keys).orderBy(*order)
    small = deal(small, rows or 0, keys)
    out = small.withColumn(name, F.row_number().over(line) - 1 + F.lit(0).cast("bigint"))
    return out if large is None else out.unionByName(_rank_ranges(large, keys, order, name, rows))


def tasks_for(spark, rows: int):
    """How many tasks sort this many rows, or None where Spark's own choice will do.

    Left alone, adaptive execution gives a task 64 MB as shuffled, which narrow rows that
    compress well outgrow many times over when they are sorted.
    """
    tasks = -(-rows // TASK_ROWS)
    return tasks if tasks > spark.sparkContext.defaultParallelism else None


def deal(df: DataFrame, rows: int, keys: list[str]) -> DataFrame:
    """Shuffle `rows` rows by keys ahead of a window, to as many tasks as they need."""
    tasks = tasks_for(df.sparkSession, rows)
    return df if tasks is None else df.repartition(tasks, *keys)


def in_ranges(df: DataFrame, rows: int, columns: list[str]) -> DataFrame:
    """Write `rows` rows out by ranges of the columns, numbered by `_range`."""
    tasks = tasks_for(df.sparkSession, rows)
    ranged = df.repartitionByRange(*([] if tasks is None else [tasks]), *columns)
    return durable(ranged.withColumn("_range", F.spark_partition_id()))


def shifted(df: DataFrame, shift: DataFrame, keys: list[str]) -> DataFrame:
    """Join with the shifts of ranges; few of them do not shuffle the rows."""
    shift = durable(shift)
    few = shift.count() <= BROADCAST_KEYS
    return same_join(df, F.broadcast(shift) if few else shift, keys)


def _rank_ranges(df, keys, order, name, rows):
    sort = {f"_o{i}": c for i, c in enumerate(order)}
    ranged = in_ranges(df.withColumns(sort), rows, [*keys, *sort])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shift = (
        ranged.groupBy(*keys, "_range")
        .count()
        .withColumn("_shift", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
        .drop("count")
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(*sort)
    placed = deal(ranged, rows, [*keys, "_range"]).withColumn(name, F.row_number().over(inside) - 1)
    return (
        shifted(placed, shift, keys + ["_range"])
        .withColumn(name, F.col(name) + F.col("_shift"))
        .drop("_range", "_shift", *sort)
    )


def number_rows(df, keys, order, name):
    """Number rows from 1 within each key by an order column, nulls first.

    The rows are cut by rank, so neither a key with very many rows nor an order
    column with gaps brings all of them to one task.
    """
    ranked = rank_large(df, keys, [F.col(order)], name)
    return ranked.withColumn(name, F.col(name) + 1)
