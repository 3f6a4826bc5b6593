"""Importance resampling towards a target text, with bit-sliced sums.

Features of a text are all runs of 1 to `longest` words; their crc32 deals them to
`buckets`. A bucket's gain says how much more usual its features are in the target
than in the documents. A document's weight is the sum of gains over its features, and
the documents with the highest weight plus Gumbel noise are drawn: a sample in
proportion to the importance weights, without replacement.

The sums are bit-sliced. A document's bucket counts become planes of one bit per
bucket, plane p holding bit p of every count; gains become such planes too, apart for
either sign. Each pair of planes is ANDed and its ones are counted, and the counts,
times powers of two, add up to the exact integer weight.

Totals are added up in the tasks before they are shuffled: a task sends one row per
bucket. Only the totals (one number per bucket) reach the driver. Ranks are given by
range-sorted parts, so no task sorts all documents.

Defined results: null text counts as empty, an empty text has weight 0 and is never
drawn; a null id is hashed as an empty one and comes before others in ties; repeated
rows are documents of their own, which share their score; empty documents give no
rows, an empty target leaves the gains of unseen text; other columns are ignored.
"""

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.groups import durable, rank_large
from .tables import slices, table

BUCKETS = 10_000
# Texts whose counts are held at once.
ROWS = 64
# Words whose buckets a task remembers; then it starts anew.
REMEMBERED = 1 << 20

# Bytes of words, upper case folded; all others become spaces.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


class _Buckets(dict):
    """Buckets of features, computed once each."""

    def __init__(self, buckets):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature):
        if len(self) >= REMEMBERED:
            self.clear()
        self[feature] = found = zlib.crc32(feature) % self.buckets
        return found


def words_of(text):
    """The words of a text as bytes, A-Z in lower case."""
    return (text or "").encode().translate(_FOLD).split()


def features_of(words, longest):
    out = words
    for size in range(2, longest + 1):
        out = out + [b" ".join(run) for run in zip(*(words[i:] for i in range(size)), strict=False)]
    return out


def _dealt(texts, known, longest):
    """Per text the number of words; of all texts the buckets and the texts' bounds."""
    n_words, ends, dealt = [], [0], []
    for text in texts:
        words = words_of(text)
        n_words.append(len(words))
        dealt.extend(map(known.__getitem__, features_of(words, longest)))
        ends.append(len(dealt))
    return n_words, np.array(dealt, np.int64), np.array(ends)


def _bucket_sums(buckets, longest):
    def run(batches):
        known, sums = _Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                _, dealt, _ = _dealt(part.column("text").to_pylist(), known, longest)
                sums += np.bincount(dealt, minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["bucket", "n"])

    return run


def bucket_totals(rows: DataFrame, buckets=BUCKETS, longest=1) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    sums = rows.select("text").mapInArrow(_bucket_sums(buckets, longest), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in sums.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of the ratio of smoothed shares, rounded down."""
    n, of_docs, of_target = len(source), float(source.sum()), float(target.sum())
    ratios = (target + 1.0) * (of_docs + n) / ((source + 1.0) * (of_target + n))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios.tolist()], np.int64)


def gain_planes(gain: np.ndarray):
    """Planes of the gains' bits, and what a one in each of them is worth."""
    wide = -(-len(gain) // 64) * 64
    planes, worth = [], []
    for sign in (1, -1):
        size = np.where(sign * gain > 0, np.abs(gain), 0)
        for q in range(int(size.max()).bit_length()):
            bits = np.zeros(wide, bool)
            bits[: len(gain)] = size >> q & 1
            planes.append(np.packbits(bits, bitorder="little").view(np.uint64))
            worth.append(sign << q)
    planes = np.stack(planes) if planes else np.zeros((0, wide // 64), np.uint64)
    return planes, np.array(worth, np.int64)


def bit_sliced_weights(dealt, ends, planes, worth) -> np.ndarray:
    """Sums of gains per text from the buckets of its features."""
    n, wide = len(ends) - 1, planes.shape[1] * 64
    out = np.zeros(n, np.int64)
    row = np.repeat(np.arange(n), np.diff(ends))
    counts = np.bincount(row * wide + dealt, minlength=n * wide)
    at = np.flatnonzero(counts)
    counts = counts[at]
    for p in range(int(counts.max()).bit_length() if len(at) else 0):
        ones = at[counts >> p & 1 == 1]
        some, first = np.unique(ones // wide, return_inverse=True)
        bits = np.zeros(len(some) * wide, bool)
        bits[first * wide + ones % wide] = True
        mine = np.packbits(bits, bitorder="little").view(np.uint64).reshape(len(some), wide // 64)
        for plane, value in zip(planes, worth.tolist(), strict=True):
            both = np.bitwise_count(mine & plane).sum(1, dtype=np.int64)
            out[some] += both * (value << p)
    return out


WEIGHED = "doc_id long, n_words long, n_features long, weight long"


def _weights(planes, worth, buckets, longest):
    def run(batches):
        known = _Buckets(buckets)
        for batch in batches:
            for part in slices(batch, "text"):
                for at in range(0, part.num_rows, ROWS):
                    some = part.slice(at, ROWS)
                    n_words, dealt, ends = _dealt(some.column("text").to_pylist(), known, longest)
                    weight = bit_sliced_weights(dealt, ends, planes, worth)
                    yield pa.RecordBatch.from_arrays(
                        [
                            some.column("doc_id"),
                            pa.array(n_words, pa.int64()),
                            pa.array(np.diff(ends)),
                            pa.array(weight),
                        ],
                        ["doc_id", "n_words", "n_features", "weight"],
                    )

    return run


def weighed(docs: DataFrame, target: DataFrame, buckets=BUCKETS, longest=1) -> DataFrame:
    """Per document: doc_id, n_words, n_features and the exact weight."""
    gain = gains(bucket_totals(docs, buckets, longest), bucket_totals(target, buckets, longest))
    run = _weights(*gain_planes(gain), buckets, longest)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, WEIGHED)


def resampled(
    docs: DataFrame, target: DataFrame, percent=10, least=20, seed="2024", buckets=BUCKETS, longest=1
) -> DataFrame:
    """Per document also score and rank; `percent` of those with `least` words are drawn."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = durable(
        weighed(docs, target, buckets, longest).withColumn("score", F.col("weight") + noise)
    )
    able = rows.where(F.col("n_words") >= least).select("doc_id", "n_words", "n_features", "weight", "score")
    order = [-F.col("score"), F.col("doc_id"), F.col("n_features")]
    ranked = rank_large(able, [], order, "place")
    drawn = able.count() * percent // 100
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).cast("long")
    rest = rows.where(F.col("n_words") < least)
    return ranked.withColumn("rank", rank).drop("place").unionByName(
        rest.withColumn("rank", F.lit(None).cast("long"))
    )


SQL = r"""
with recursive steps as (
  select range as byte, range::bigint as value, 0 as k from range(256)
  union all
  select byte, case when value & 1 = 1 then xor(value >> 1, 3988292384) else value >> 1 end, k + 1
  from steps where k < 8),
crc as (select list(value order by byte) as entries from steps where k = 8),
texts as (
  select 'd' as side, row_number() over () as id, doc_id, text from documents
  union all select 'b', row_number() over (), null, text from benchmark),
listed as (
  select side, id, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from texts),
counted as (
  select side, id, word, count(*) as n
  from (select side, id, unnest(words) as word from listed) group by all),
hashed as (
  select word, xor(list_reduce([4294967295::bigint] || list_transform(range(octet_length(encode(word))),
      lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::bigint),
      lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295::bigint) % 10000 as bucket
  from (select distinct word from counted), crc),
filed as (
  select side, id, bucket, sum(n) as n from counted join hashed using (word) group by all),
totals as (
  select range as bucket, coalesce(sum(n) filter (side = 'd'), 0)::double as s,
    coalesce(sum(n) filter (side = 'b'), 0)::double as t
  from range(10000) left join filed on range = bucket group by range),
gains as (
  select bucket, floor(1000 * ln((t + 1) * (sum(s) over () + 10000)
    / ((s + 1) * (sum(t) over () + 10000))))::bigint as gain from totals),
weights as (
  select id, sum(n * gain)::bigint as weight from filed join gains using (bucket)
  where side = 'd' group by id),
scored as (
  select doc_id, len(words)::bigint as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' ||
      coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from listed left join weights using (id) where side = 'd'),
ranked as (
  select *, n_features >= 20 as able, row_number() over (partition by n_features >= 20
    order by score desc, doc_id nulls first, n_features) as place,
    count(*) filter (n_features >= 20) over () as n from scored)
select doc_id, n_features, weight, score,
  case when able and place <= n * 10 // 100 then place end as rank from ranked
"""


def op13_resampling(spark, sf_dir):
    """All documents weighed against the benchmark's texts; a tenth is drawn."""
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resampled(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op13_resampling": op13_resampling}
ORACLES = {"op13_resampling": SQL}
