"""Quality by compression: which dictionary makes a text smaller, good or bad text?

Two zstandard dictionaries are built from snippets of labelled good and bad texts.
Every whole text is compressed in pieces of `PIECE` bytes with each dictionary and
with none. The difference of the two sizes over their mean is the main value; a
logistic curve over it and the three size ratios, fitted on labelled rows that the
dictionaries have not seen, makes it a probability of label 1.

The fit takes at most `PER_LABEL` labelled documents of each label (lowest hash of
the id): one half for the dictionaries, by snippets of `SNIPPET` characters, one
half for the curve, by their whole texts. Sizes of all labelled rows give the share
of label 1.

Defined results: null text counts as empty; an empty text gets the curve's value for
differences and ratios of 0; null labels and ids are not learned; several labels of one
document count each; with no labelled text, or one label only, the score is the
share of label 1 (0.5 without labels); equal texts get equal scores; other columns
are ignored.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import bounded_sample, held_out, slices, table
from .words import text_buffer

PER_LABEL = 3000
SNIPPET = 2048
PIECE = 2048
LEVEL = 1
DICTIONARY = 64 << 10
LEAST = 0.7


class Sizes:
    """Compressed sizes of texts under two dictionaries and none."""

    def __init__(self, dictionaries):
        plain = dict(level=LEVEL, write_checksum=False, write_content_size=False)
        self.compressors = []
        for raw in dictionaries:
            trained = zstandard.ZstdCompressionDict(raw)
            trained.precompute_compress(level=LEVEL)
            self.compressors.append(
                zstandard.ZstdCompressor(dict_data=trained, write_dict_id=False, **plain)
            )
        self.compressors.append(zstandard.ZstdCompressor(**plain))

    def values(self, column) -> np.ndarray:
        """Per text: the normalised difference and the three ratios (0 if empty)."""
        data, offsets = text_buffer(column)
        raw = memoryview(data) if len(data) else memoryview(b"")
        out = np.zeros((len(offsets) - 1, 4))
        for i, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            if low == high:
                continue
            total = [0, 0, 0]
            for at in range(low, high, PIECE):
                piece = raw[at : min(at + PIECE, high)]
                for k, c in enumerate(self.compressors):
                    total[k] += len(c.compress(piece))
            good, bad, none = total
            n = high - low
            out[i] = 2 * (bad - good) / (bad + good), good / n, bad / n, none / n
        return out


def _inputs(values):
    logs = np.log(np.maximum(values[:, 1:], 1e-3))
    empty = values[:, 1:2] == 0
    return np.c_[np.ones(len(values)), values, np.where(empty, 0, logs)]


def fit_curve(values, labels, share, rounds=30):
    """Logistic weights; rows are weighted so that label 1 has `share` of the weight."""
    x, y = _inputs(values), np.asarray(labels, float)
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    theta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - 1e-3 * theta
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(theta))
        theta = theta + np.linalg.solve(bend, slope)
    return theta


def score_values(theta, values):
    return 1 / (1 + np.exp(-np.clip(_inputs(values) @ theta, -30, 30)))


def sizes_of(docs: DataFrame, dictionaries, keep, finish, schema) -> DataFrame:
    """`keep` columns and what `finish` makes of the texts' values."""

    def measure(batches):
        sizes = Sizes(dictionaries)
        for batch in batches:
            for part in slices(batch, "text"):
                made = finish(sizes.values(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k) for k in keep], *made], schema.names
                )

    return docs.select(*keep, *(["text"] if "text" not in keep else [])).mapInArrow(
        measure, schema
    )


def fit(docs: DataFrame, labels: DataFrame, per_label=PER_LABEL):
    """Dictionaries and curve from labelled rows that are not held out."""
    labels = labels.select("doc_id", F.col("quality").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out()
    )
    n = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    if min(n.get(0, 0), n.get(1, 0)) < 2:
        share = n.get(1, 0) / sum(n.values()) if n else 0.5
        return {"share": share, "dictionaries": None, "theta": None}
    share = n[1] / (n[0] + n[1])
    chosen = []
    for label in (0, 1):
        rows = labels.where(F.col("label") == label).select(
            F.xxhash64("doc_id").alias("h"), "doc_id", "label"
        )
        # At most `per_label` ids, every other one for the dictionaries.
        chosen += [
            (i, label, at % 2 == 0)
            for at, (_, i, label) in enumerate(bounded_sample(rows, per_label))
        ]
    spark, picked = docs.sparkSession, chosen
    picked = F.broadcast(spark.createDataFrame(picked, "doc_id long, label int, learn boolean"))
    texts = docs.select("doc_id", "text").join(picked, "doc_id").where("length(text) > 0")
    place = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - SNIPPET, F.lit(1)))
    snippets = (
        texts.where("learn")
        .select(
            "label",
            F.substring("text", place.cast("int") + 1, F.lit(SNIPPET)).alias("text"),
        )
        .limit(4 * per_label)
        .collect()
    )
    dictionaries = []
    for label in (1, 0):
        samples = sorted(r.text.encode() for r in snippets if r.label == label)
        dictionaries.append(_dictionary(samples))
    schema = docs.select("doc_id").schema.add("label", T.IntegerType())
    schema = schema.add("values", T.ArrayType(T.DoubleType()))
    kept = texts.where("not learn").select("doc_id", "label", "text")
    rows = sizes_of(
        kept, dictionaries, ["doc_id", "label"], lambda v: [pa.array(list(v))], schema
    )
    rows = sorted((tuple(r["values"]), r["label"]) for r in rows.limit(4 * per_label).collect())
    theta = None
    if len({label for _, label in rows}) == 2:
        theta = fit_curve(np.array([v for v, _ in rows]), [y for _, y in rows], share)
    return {"share": share, "dictionaries": dictionaries, "theta": theta}


def _dictionary(samples):
    """A trained dictionary, or the samples themselves where they are too few."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:] or b"\0" * 16


def score(docs: DataFrame, model, keep=("doc_id",)) -> DataFrame:
    """`keep` columns of every row and its score."""
    schema = docs.select(*keep).schema.add("score", "double")
    if model["theta"] is None:
        return docs.select(*keep, F.lit(float(model["share"])).alias("score"))
    theta = model["theta"]
    return sizes_of(
        docs,
        model["dictionaries"],
        list(keep),
        lambda values: [pa.array(score_values(theta, values))],
        schema,
    )


def op3_quality(spark, sf_dir):
    """The quality score of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= LEAST).cast("int").alias("predicted"),
    )


QUERIES = {"op3_quality": op3_quality}
