"""The last lines of each run while its log is still being written.

Each task keeps the last lines that it has of a run, so however long a batch is, few go
to the run's state: a ring of lines in the state store, from which older lines are
evicted. With each batch in which a run has lines, its tail goes out.
"""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.text import clean_line
from ..operators.groups import skew_join

# Lines kept of a run, lines shown.
KEPT_LINES = 4000
SHOWN_LINES = 400

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TAIL = "run {kind}, seq long, line string"


def _last(rows: pd.DataFrame, n, by):
    """The n rows with the highest seq of each group; of lines with one seq the last."""
    rows = rows.drop_duplicates([*by, "seq"], keep="last").sort_values("seq", kind="stable")
    return rows.groupby(by, dropna=False, sort=False).tail(n) if by else rows.tail(n)


def _reduced(kept):
    def run(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch])
            held = _last(held, kept, ["run"])
        if held is not None:
            yield held

    return run


class Ring(StatefulProcessor):
    """The last `kept` lines of a run; gives the last `shown` of them."""

    def __init__(self, kept, shown):
        self.kept, self.shown = kept, shown

    def init(self, handle):
        self.lines = handle.getListState("lines", "seq long, line string")

    def handleInputRows(self, key, rows, timerValues):
        held = pd.DataFrame(list(self.lines.get()), columns=["seq", "line"])
        for batch in rows:
            held = _last(pd.concat([held, batch[["seq", "line"]]]), self.kept, [])
        held = held.astype({"seq": "int64"})
        self.lines.put([(int(s), t) for s, t in zip(held["seq"], held["line"], strict=True)])
        tail = held.tail(self.shown)
        tail.insert(0, "run", key[0])
        yield tail

    def close(self):
        pass


def follow_tails(stream: DataFrame, path, checkpoint, shown=SHOWN_LINES, kept=KEPT_LINES, trigger=None):
    """Start a stream of log lines (run, seq, line); tails go to `path`, by batch.

    Lines are cleaned first. Of lines with one seq the last to come stays; a line that
    is older than all that are kept is dropped. Lines without a seq are left out.
    """
    if not 0 < shown <= kept:
        raise ValueError("shown lines must be some of the kept ones")
    spark = stream.sparkSession
    lines = stream.where("seq is not null").select(
        "run", F.col("seq").cast("long").alias("seq"), clean_line("line").alias("line")
    )
    schema = TAIL.format(kind=stream.schema["run"].dataType.simpleString())
    tails = (
        lines.mapInPandas(_reduced(kept), schema)
        .groupBy("run")
        .transformWithStateInPandas(Ring(kept, shown), schema, "Update", "None")
    )

    def put(rows, batch):
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = tails.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        # A query keeps the settings it was started with.
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def read_tails(spark, path) -> DataFrame:
    """The latest tail of every run: run, seq, line."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy("run").agg(F.max("batch").alias("batch"))
    return skew_join(rows, newest, ["run", "batch"]).select("run", "seq", "line")
