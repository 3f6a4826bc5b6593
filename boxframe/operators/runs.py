"""Run logs and run states."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_line
from .groups import PUSHED_LIMIT, number_rows, salted_join

# Fixed value: lines shown of a run.
SHOWN_LINES = 400


def clean_log(lines):
    return lines.withColumn("line", clean_line("line"))


def log_tail(lines: DataFrame, n: int = SHOWN_LINES) -> DataFrame:
    """The last n lines of each run; seq is a whole number.

    A small row-number limit is applied before the shuffle, so each task sends
    at most n lines of a run, however long its log is. For a larger n the lines
    are numbered from the end by rank.
    """
    if n <= PUSHED_LIMIT:
        latest = Window.partitionBy("run").orderBy(F.desc("seq"))
        numbered = lines.withColumn("_n", F.row_number().over(latest))
    else:
        back = lines.withColumn("_back", -F.col("seq"))
        numbered = number_rows(back, ["run"], "_back", "_n").drop("_back")
    return numbered.where(F.col("_n") <= n).drop("_n")


def run_states(events: DataFrame) -> DataFrame:
    """One row per run: idle, running, completed, failed or killed.

    `events` has run, seq (order), kind (start, kill, exit, ...), return_code.
    The first exit after the first start counts. A kill before that exit wins
    over its return code; a kill at any other time changes nothing.
    """
    order = F.col("seq")
    starts = events.groupBy("run").agg(
        F.min(F.when(F.col("kind") == "start", order)).alias("started")
    )
    ends = events.where(F.col("kind").isin("exit", "kill"))
    after = salted_join(ends, starts, ["run"], "seq").where(order > F.col("started"))
    found = after.groupBy("run").agg(
        F.min(F.when(F.col("kind") == "exit", F.struct("seq", "return_code"))).alias("e"),
        F.min(F.when(F.col("kind") == "kill", order)).alias("killed"),
    )
    rows = starts.join(found, "run", "left")
    finished = F.col("e.seq")
    killed = F.col("killed").isNotNull() & (
        finished.isNull() | (F.col("killed") < finished)
    )
    state = (
        F.when(F.col("started").isNull(), "idle")
        .when(killed, "killed")
        .when(finished.isNull(), "running")
        .when(F.col("e.return_code") == 0, "completed")
        .otherwise("failed")
    )
    return rows.select(
        "run",
        state.alias("state"),
        "started",
        finished.alias("finished"),
        F.col("e.return_code").alias("return_code"),
    )


def run_status(events, lines, n=SHOWN_LINES):
    """Run states with the last cleaned lines of each run, oldest first."""
    tail = clean_log(log_tail(lines, n)).groupBy("run").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda r: r["line"]
        ).alias("log_lines")
    )
    empty = F.array().cast("array<string>")
    return run_states(events).join(tail, "run", "left").withColumn(
        "log_lines", F.coalesce("log_lines", empty)
    )


def overlapping_runs(spans: DataFrame, slice_width: int) -> DataFrame:
    """Runs that start while an earlier one has not finished.

    `spans` has run, started and finished as whole numbers (finished null while
    running). Starts are cut into slices of `slice_width`; the latest finish of
    earlier slices comes from one row per slice.
    """
    open_end = F.lit((1 << 63) - 1)
    cut = spans.where("started is not null").withColumns(
        {
            "_slice": F.floor(F.col("started") / F.lit(slice_width)),
            "_end": F.coalesce("finished", open_end),
        }
    )
    line = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    earlier = cut.groupBy("_slice").agg(F.max("_end").alias("m")).select(
        "_slice", F.max("m").over(line).alias("_before")
    )
    inside = Window.partitionBy("_slice").orderBy("started", "run").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        cut.join(earlier, "_slice")
        .withColumn("_latest", F.greatest("_before", F.max("_end").over(inside)))
        .where(F.col("_latest") > F.col("started"))
        .drop("_slice", "_end", "_before", "_latest")
    )
