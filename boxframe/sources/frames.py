"""Recorded frame reads as a batch or a stream."""

from pyspark.sql import functions as F

FRAMES = "source string, read_idx long, ok boolean, dt_s double, n_dets int"


def read_frames(spark, path, schema=FRAMES, format="parquet"):
    return spark.read.schema(schema).format(format).load(path)


def stream_frames(spark, path, schema=FRAMES, format="parquet", files_per_batch=None):
    """Frame records as they arrive; one file holds one source's reads in order."""
    reader = spark.readStream.schema(schema).format(format)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def stream_lines(spark, path, files_per_batch=None):
    """Lines of growing text folders: run (the file), seq (from 1) and line.

    A file is read whole, because lines of a split file would have no numbers.
    """
    reader = spark.readStream.format("text").option("wholetext", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    text = F.regexp_replace("value", r"(\r\n|\n|\r)\z", "")
    lines = F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("p", "line")
    named = reader.load(path).select(
        F.url_decode("_metadata.file_name").alias("run"), "value"
    )
    return named.select("run", lines).select(
        "run", (F.col("p") + 1).alias("seq"), "line"
    )
