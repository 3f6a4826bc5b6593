"""Token counts as delta-maintained rollups.

A change names a document's image before and after (source, lang, text): an insert
has no before, a delete no after, a revision both. Each image is counted with every
tokenizer version; before-images count with sign -1, after-images with +1. The sums
by source, language and tokenizer version are the batch's delta, a few rows however
large the batch. A store holds one folder per committed batch; totals are the sum
over the folders.

A commit writes aside and then renames to the batch's folder, which must be new, so a
batch is there whole or not at all, and a repeated commit of the same batch changes
nothing; of two at once, one succeeds. On stores whose rename is not atomic, commits of
one batch must not run at once. A compacted store remembers the batches it was made of.

Defined results: null text counts 0 tokens but 1 document; a null source or language
is a key of its own; a change without images counts nothing; repeated changes count
each; totals that come to no documents and no tokens are left out; an empty batch
commits an empty folder; other columns are ignored.
"""

import base64
from collections.abc import Iterator

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.groups import _hadoop_path, put_new, remove, scratch_path
from .tables import table

WORDS = r"[^\x20\x09-\x0D]+"
PIECES = r"\p{L}+|\p{N}+|[^\p{L}\p{N}\x20\x09-\x0D]"
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def pattern_counter(pattern):
    """A tokenizer version whose tokens are the matches of a pattern."""
    return lambda text: F.regexp_count(text, F.lit(pattern)).cast("long")


def ranked_counter(path, pattern):
    """A tokenizer version from a file of byte-pair ranks (base64 token, rank), which
    must be readable at `path` on every executor."""

    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for texts in parts:
            yield texts.map(lambda t: len(coder.encode_ordinary(t)) if t else 0).astype("int64")

    return F.pandas_udf(count, "long")


TOKENIZERS = {"words-1": pattern_counter(WORDS), "pieces-1": pattern_counter(PIECES)}


IMAGE = "struct<source:string,lang:string,text:string>"


def inserts(docs: DataFrame) -> DataFrame:
    image = F.struct("source", "lang", "text")
    return docs.select(F.lit(None).cast(IMAGE).alias("before"), image.alias("after"))


def deletes(docs: DataFrame) -> DataFrame:
    return inserts(docs).select(F.col("after").alias("before"), F.col("before").alias("after"))


def revisions(docs: DataFrame, new_text) -> DataFrame:
    """`docs` as they were, with `new_text` (a Column over them) from now on."""
    return docs.select(
        F.struct("source", "lang", "text").alias("before"),
        F.struct("source", "lang", new_text.alias("text")).alias("after"),
    )


def delta(changes: DataFrame, tokenizers=None) -> DataFrame:
    """Signed sums of a batch by source, lang and tokenizer version."""
    tokenizers = tokenizers or TOKENIZERS
    sides = F.array(
        F.struct(F.lit(-1).alias("sign"), F.col("before").alias("image")),
        F.struct(F.lit(1).alias("sign"), F.col("after").alias("image")),
    )
    rows = changes.select(F.explode(sides).alias("side")).where("side.image is not null")
    rows = rows.select("side.sign", "side.image.*")
    # One reading of each text gives all its counts; sums come before any reshaping.
    names = list(tokenizers)
    counted = rows.select(
        "source",
        "lang",
        "sign",
        *[
            (F.col("sign") * F.coalesce(tokenizers[n](F.col("text")), F.lit(0))).alias(f"_{i}")
            for i, n in enumerate(names)
        ],
    )
    sums = counted.groupBy("source", "lang").agg(
        F.sum(F.col("sign").cast("long")).alias("n_docs"),
        *[F.sum(f"_{i}").alias(f"_{i}") for i in range(len(names))],
    )
    each = F.array(
        *[
            F.struct(F.lit(n).alias("tokenizer"), "n_docs", F.col(f"_{i}").alias("n_tokens"))
            for i, n in enumerate(names)
        ]
    )
    return sums.select("source", "lang", F.explode(each).alias("e")).select("source", "lang", "e.*")


# Batches that a compacted store was made of; readers of the sums pass over the name.
MERGED = "_merged"


def committed(spark, store, batch) -> bool:
    """Whether a batch is in the store, by itself or among those merged."""
    path, files = _hadoop_path(spark, f"{store}/batch={batch}")
    if files.exists(path):
        return True
    merged = _merged(spark, store)
    return merged is not None and not merged.where(F.col("batch") == str(batch)).isEmpty()


def _merged(spark, store):
    path, files = _hadoop_path(spark, f"{store}/{MERGED}")
    return spark.read.schema("batch string").parquet(f"{store}/{MERGED}") if files.exists(path) else None


def commit(store, batch, changes: DataFrame, tokenizers=None) -> bool:
    """Add a batch's delta to the store; False, and no effect, if it is there already."""
    spark = changes.sparkSession
    if committed(spark, store, batch):
        return False
    aside = scratch_path(spark, "delta")
    delta(changes, tokenizers).write.parquet(aside)
    if put_new(spark, aside, f"{store}/batch={batch}"):
        return True
    remove(spark, aside)
    return False


def totals(spark, store) -> DataFrame:
    """Documents and tokens by source, lang and tokenizer over all batches."""
    return (
        spark.read.schema(DELTA)
        .parquet(store)
        .groupBy("source", "lang", "tokenizer")
        .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        .where("n_docs <> 0 or n_tokens <> 0")
    )


def compact(spark, store, into) -> str:
    """Write all batches' sums as the one batch of a new store, and return it.

    The new store keeps the names of the batches, so none can be committed again. No
    commit may run meanwhile.
    """
    path, files = _hadoop_path(spark, store)
    found = [f.getPath().getName() for f in files.listStatus(path)]
    names = [(n.removeprefix("batch="),) for n in found if n.startswith("batch=")]
    merged, before = spark.createDataFrame(names, "batch string"), _merged(spark, store)
    if before is not None:
        merged = merged.unionByName(before)
    merged.write.parquet(f"{into}/{MERGED}")
    totals(spark, store).write.parquet(f"{into}/batch=compacted")
    return into


SQL = rf"""
with state as (
  select source, lang,
    case when regexp_matches(coalesce(text, ''), '[0-9]') then regexp_replace(text, '[0-9]+', ' ', 'g')
      else text end as text,
    coalesce(len(regexp_extract_all(text, '{WORDS}')), 0) as words
  from documents),
kept as (select * from state where words >= 50),
counted as (
  select source, lang, 'words-1' as tokenizer, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0) as n from kept
  union all
  select source, lang, 'pieces-1', coalesce(len(regexp_extract_all(text, '{PIECES}')), 0) from kept)
select source, lang, tokenizer, count(*)::bigint as n_docs, sum(n)::bigint as n_tokens
from counted group by all
"""


def op6_token_rollups(spark, sf_dir):
    """All documents inserted, those with digits revised without them, short ones
    deleted; batches committed twice count once."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", "text")
    store = scratch_path(spark, "rollup")
    digits = F.coalesce(F.col("text").rlike("[0-9]"), F.lit(False))
    plain = F.when(digits, F.regexp_replace("text", "[0-9]+", " ")).otherwise(F.col("text"))
    short = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)) < 50
    batches = {
        "1": inserts(docs),
        "2": revisions(docs.where(digits), plain),
        "3": deletes(docs.where(short).select("source", "lang", plain.alias("text"))),
    }
    for batch, changes in batches.items():
        commit(store, batch, changes)
    commit(store, "2", batches["2"])
    return totals(spark, store)


QUERIES = {"op6_token_rollups": op6_token_rollups}
ORACLES = {"op6_token_rollups": SQL}
