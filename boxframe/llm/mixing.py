"""Mixing sources to target weights: documents repeated at their source's rate.

Words are summed per source; sources share `share` times all words by weight, up
to `most` times their own; a document goes out floor(rate) times, and once more
if a hash of it, read as a number in [0, 1), is below the fraction of the rate.
Everything is DataFrame code.

Defined results: null text counts as empty (size 0); a null source is a source of
its own, last in order; a source without words has target 0 and rate 1, so its
empty documents go out once; repeated rows decide alike, as the hash sees only
`doc_id` and text; an empty table gives no rows; other columns are kept.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.groups import durable, same_join, skew_join
from .tables import table

WORD = r"[^\x20\x09-\x0D]+"
# Largest table of sources, in bytes of their names, that is sent to all executors.
BROADCAST_BYTES = 8 << 20


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sizes: DataFrame) -> DataFrame:
    """Sources with their words and their place (from 0) by code point, null last.

    Sources are range-sorted; places are those in a range plus the counts of the
    ranges before, so no task gets all sources.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    ranged = durable(
        per_source.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        ranged.groupBy("_range")
        .count()
        .select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    return ranged.join(F.broadcast(shift), "_range").select(
        "source",
        "source_size",
        (F.row_number().over(inside) - 1 + F.col("_shift")).alias("place"),
    )


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share=1.5, most=2.0) -> DataFrame:
    """Targets per source of `sizes` (source, size): source, source_size, target, rate.

    The level that weights are multiplied with rises until no source beyond its
    limit is left: each round is one sum over the sources.
    """
    by_place = F.array(*[F.lit(float(w)) for w in weights])
    per_source = durable(
        _ranked(sizes).select(
            "source",
            "source_size",
            F.get(by_place, (F.col("place") % len(weights)).cast("int")).alias("weight"),
        )
    )
    limit = F.col("source_size") * float(most)
    total = per_source.agg(F.sum("source_size")).first()[0] or 0
    level, held = 0.0, -1
    while True:
        full = limit <= F.lit(level) * F.col("weight")
        now = per_source.agg(
            F.count(F.when(full, 1)).alias("held"),
            F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)).alias("words"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weights"),
        ).first()
        if now.held == held or not now.weights:
            break
        held, level = now.held, (share * total - most * now.words) / now.weights
    target = F.least(limit, F.lit(level) * F.col("weight"))
    return per_source.select(
        "source",
        "source_size",
        target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size"))
        .otherwise(1.0)
        .alias("rate"),
    )


def sized(docs: DataFrame, seed="mix", *more) -> DataFrame:
    """doc_id, source, size, and the draw in [0, 1) that a document's hash gives."""
    key = F.concat_ws(
        "|",
        F.lit(seed),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
        F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")),
    )
    draw = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double")
    return docs.select(
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        (draw / F.lit(float(1 << 52))).alias("draw"),
        *more,
    )


def with_rates(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Join targets to documents; targets go to all executors if they are small."""
    size = targets.agg(
        F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + F.lit(32))
    ).first()[0]
    if (size or 0) <= BROADCAST_BYTES:
        return same_join(docs, F.broadcast(targets), ["source"])
    return skew_join(docs, targets, ["source"])


def copies():
    """floor(rate), and one more where the draw is below the fraction."""
    whole = F.floor("rate")
    return (whole + F.when(F.col("draw") < F.col("rate") - whole, 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, weights=(5, 2, 1), share=1.5, most=2.0, seed="mix") -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, rate, copies, taken."""
    sizes = durable(sized(docs, seed))
    targets = durable(source_targets(sizes, weights, share, most))
    return (
        with_rates(sizes, targets)
        .withColumn("copies", copies())
        .withColumn("taken", F.col("size") * F.col("copies"))
        .drop("draw")
    )


def mixed_rows(docs: DataFrame, weights=(5, 2, 1), share=1.5, most=2.0, seed="mix") -> DataFrame:
    """The mix itself: every row of `docs` as often as it is taken, with `copy` from 1
    (with underscores after the name if `docs` has such a column).

    Texts are not shuffled: sizes are summed first, rates go to the rows.
    """
    name = "copy"
    while name in docs.columns:
        name += "_"
    sizes = durable(sized(docs, seed).groupBy("source").agg(F.sum("size").alias("size")))
    targets = durable(source_targets(sizes, weights, share, most))
    row = F.struct(*docs.columns).alias("row")
    return (
        with_rates(sized(docs, seed, row).drop("size"), targets)
        .withColumn("copies", copies())
        .where("copies > 0")
        .select("row.*", F.explode(F.expr("sequence(1, int(copies))")).alias(name))
    )


SQL = r"""
with sized as (
  select doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5('mix|' || coalesce(doc_id::varchar, '') || '|' ||
      md5(coalesce(text, ''))), 1, 13))::bigint / 4503599627370496.0 as draw
  from documents),
per as (
  select source, sum(size)::bigint as source_size,
    case (row_number() over (order by source is null, source) - 1) % 3
      when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight
  from sized group by source),
total as (select 1.5::double * sum(source_size)::double as words from per),
filled as (
  select *, words - 2.0::double * coalesce(sum(source_size) over earlier, 0)::double as rest,
    sum(weight) over later as weights,
    row_number() over (order by source_size / weight, source is null, source) as place
  from per, total
  window earlier as (order by source_size / weight, source is null, source
      rows between unbounded preceding and 1 preceding),
    later as (order by source_size / weight, source is null, source
      rows between current row and unbounded following)),
level as (
  select rest / weights as height from filled
  where 2.0::double * source_size > rest / weights * weight order by place limit 1),
targets as (
  select source, source_size,
    least(2.0::double * source_size, coalesce(height, 0) * weight) as target,
    case when source_size > 0
      then least(2.0::double * source_size, coalesce(height, 0) * weight) / source_size
      else 1.0::double end as rate
  from per left join level on true)
select doc_id, size, source_size, target,
  (size * (floor(rate) + case when draw < rate - floor(rate) then 1 else 0 end))::bigint as taken
from sized join targets on sized.source is not distinct from targets.source
"""


def op2_mixing(spark, sf_dir):
    """All documents with what the mix takes of each."""
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


QUERIES = {"op2_mixing": op2_mixing}
ORACLES = {"op2_mixing": SQL}
