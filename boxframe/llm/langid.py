"""Language identification by a convolutional network over bytes.

Filters of several widths run over fixed-length windows of byte codes; each
filter's largest response per window feeds a softmax. The network is trained with
NumPy on a bounded sample of labelled texts (`PER_LANGUAGE` documents a language,
those with the lowest hash of their id in each of `SLICES` slices, one snippet of
`SNIPPET` characters from a place the hash chooses) and applied to every window of every text. A text's
language is the softmax of its windows' mean logits, weighted by their letters.

Defined results: a null text or one without letters is `und` with score 0; null
languages are not learned; without any labelled text everything is `und`; equal
texts get equal results; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import beside_text, from_beside, held_out, joined, small_batches, table
from .words import text_buffer

PER_LANGUAGE = 1024
SLICES = 64
LANGUAGES = 200
SNIPPET = 1024
LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
EPOCHS = 6
UNKNOWN = "und"


def _codes():
    """Byte to code: 0 for what is no letter, then a to z, then bytes from 128."""
    codes = np.zeros(256, np.uint8)
    codes[97:123] = codes[65:91] = np.arange(1, 27)
    codes[128:] = np.arange(27, 155)
    return codes


ALPHABET = 155


def _start(n_classes, rng):
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    net = {"embed": draw(ALPHABET, EMBEDDING, scale=0.5)}
    for w in WIDTHS:
        net[f"filter{w}"] = draw(w, EMBEDDING, FILTERS, scale=(w * EMBEDDING) ** -0.5)
    net["bias"] = np.zeros(len(WIDTHS) * FILTERS, np.float32)
    net["dense"] = draw(len(WIDTHS) * FILTERS, n_classes, scale=0.1)
    net["shift"] = np.zeros(n_classes, np.float32)
    return net


def _tables(net):
    """Per width and place, the response of each filter to each code."""
    return {w: [net["embed"] @ net[f"filter{w}"][j] for j in range(w)] for w in WIDTHS}


def _forward(net, x):
    """Pooled responses of windows x (n, LENGTH + 3 codes) and where they were."""
    tables, pooled, places = _tables(net), [], []
    for w in WIDTHS:
        r = sum(tables[w][j][x[:, j : j + LENGTH]] for j in range(w))
        at = r.argmax(axis=1)
        pooled.append(np.take_along_axis(r, at[:, None], 1)[:, 0])
        places.append(at)
    return np.concatenate(pooled, 1), places


def _softmax(z):
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _gradients(net, x, y):
    pooled, places = _forward(net, x)
    active = pooled + net["bias"]
    hidden = np.maximum(active, 0)
    p = _softmax(hidden @ net["dense"] + net["shift"])
    d = p.copy()
    d[np.arange(len(y)), y] -= 1
    d /= len(y)
    g = {"dense": hidden.T @ d, "shift": d.sum(0)}
    back = (d @ net["dense"].T) * (active > 0)
    g["bias"] = back.sum(0)
    g["embed"] = np.zeros_like(net["embed"])
    rows = np.arange(len(x))[:, None]
    for i, w in enumerate(WIDTHS):
        part = back[:, i * FILTERS : (i + 1) * FILTERS]
        g[f"filter{w}"] = np.zeros_like(net[f"filter{w}"])
        for j in range(w):
            cell = x[rows, places[i] + j].astype(np.int64) * FILTERS + np.arange(FILTERS)
            t = np.bincount(cell.ravel(), part.ravel(), ALPHABET * FILTERS)
            t = t.reshape(ALPHABET, FILTERS).astype(np.float32)
            g[f"filter{w}"][j] = net["embed"].T @ t
            g["embed"] += t @ net[f"filter{w}"][j].T
    return g, p


def _crops(text: str, rng):
    """Windows of a snippet: a whole one, and shorter ones as short texts are."""
    raw = _codes()[np.frombuffer(text.encode(), np.uint8)]
    for length in (LENGTH, int(rng.integers(16, LENGTH)), int(rng.integers(16, 96))):
        begin = int(rng.integers(0, max(1, len(raw) - length)))
        window = np.zeros(LENGTH + max(WIDTHS) - 1, np.uint8)
        part = raw[begin : begin + length]
        window[: len(part)] = part
        yield window


def fit(samples, seed=7):
    """Train on (text, language) pairs; None without any."""
    rng = np.random.Generator(np.random.PCG64(seed))
    names = sorted({lang for _, lang in samples})
    if not names:
        return None
    index = {name: i for i, name in enumerate(names)}
    x, y = [], []
    for text, lang in samples:
        for window in _crops(text, rng):
            if window.any():
                x.append(window)
                y.append(index[lang])
    if not x:
        return None
    x, y = np.stack(x), np.array(y)
    net = _start(len(names), rng)
    mean = {k: np.zeros_like(v) for k, v in net.items()}
    square = {k: np.zeros_like(v) for k, v in net.items()}
    step, steps = 0, EPOCHS * -(-len(x) // 256)
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            batch = order[at : at + 256]
            g, _ = _gradients(net, x[batch], y[batch])
            step += 1
            rate = 0.01 * (1 - step / (steps + 1))
            for k in net:
                mean[k] += 0.1 * (g[k] - mean[k])
                square[k] += 0.01 * (g[k] ** 2 - square[k])
                m, s = mean[k] / (1 - 0.9**step), square[k] / (1 - 0.99**step)
                net[k] -= (rate * m / (np.sqrt(s) + 1e-7)).astype(np.float32)
    return {"names": names, "net": net}


class Identifier:
    """A trained network with its filters folded into tables over pairs of codes."""

    def __init__(self, model, block=48):
        self.names, net = model["names"], model["net"]
        self.block = block
        t = _tables(net)
        pairs = lambda a, b: (a[:, None] + b[None]).reshape(-1, FILTERS)
        self.folded = []
        for w in WIDTHS:
            parts = [(j, pairs(t[w][j], t[w][j + 1])) for j in range(0, w - 1, 2)]
            if w % 2:
                last = np.repeat(t[w][w - 1], ALPHABET, 0)
                parts.append((w - 1, last))
            self.folded.append(parts)
        self.net = net

    def windows(self, codes):
        """Logits of the windows that a padded run of codes consists of."""
        n = (len(codes) - max(WIDTHS)) // LENGTH
        out = np.empty((n, len(self.names)), np.float32)
        left, room = np.empty((2, self.block * LENGTH, FILTERS), np.float32)
        for at in range(0, n, self.block):
            stop = min(n, at + self.block)
            low, size = at * LENGTH, (stop - at) * LENGTH
            c = codes[low : low + size + max(WIDTHS)].astype(np.intp)
            pair = c[:-1] * ALPHABET + c[1:]
            pooled = []
            for parts in self.folded:
                for i, (j, rows) in enumerate(parts):
                    to = room if i else left
                    np.take(rows, pair[j : j + size], 0, out=to[:size], mode="clip")
                    if i:
                        left[:size] += room[:size]
                r = left[:size].reshape(stop - at, LENGTH, FILTERS)
                half = LENGTH
                while half > 1:
                    half //= 2
                    r = np.maximum(r[:, :half], r[:, half : 2 * half])
                pooled.append(r[:, 0])
            hidden = np.maximum(np.concatenate(pooled, 1) + self.net["bias"], 0)
            out[at:stop] = hidden @ self.net["dense"] + self.net["shift"]
        return out

    def texts(self, column):
        """Mean logits of the texts of a column."""
        data, offsets = text_buffer(column)
        sizes = np.diff(offsets)
        n_windows = -(-(sizes + max(WIDTHS) - 1) // LENGTH)
        first = np.concatenate([[0], np.cumsum(n_windows)])
        codes = np.zeros(int(first[-1]) * LENGTH + max(WIDTHS), np.uint8)
        table = _codes()
        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            codes[first[i] * LENGTH : first[i] * LENGTH + b - a] = table[data[a:b]]
        letters = (codes[: first[-1] * LENGTH] > 0).reshape(-1, LENGTH).sum(1)
        logits = self.windows(codes) * letters[:, None]
        total = np.add.reduceat(logits, first[:-1], 0)
        weight = np.add.reduceat(letters, first[:-1])
        return total / np.maximum(weight, 1)[:, None]


def sample(docs: DataFrame, per_language=PER_LANGUAGE):
    """The bounded training sample: (text, lang) of rows that are not held out.

    Rows are taken by hash. Up to `LANGUAGES` languages have `per_language` rows each,
    more share the same number of rows evenly; where there are more languages than
    rows, a share of them by hash is learned.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - SNIPPET, F.lit(1)))
    rows = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()
    ).select(
        F.xxhash64("doc_id").alias("h"),
        "lang",
        F.substring("text", place.cast("int") + 1, F.lit(SNIPPET)).alias("text"),
    )
    most = per_language * LANGUAGES
    n = rows.agg(F.count_distinct("lang")).first()[0]
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("lang"), F.lit(n)) < most)
    share = max(1, min(per_language, most // max(n, 1)))
    # Each language is ranked in slices of the hash, so no task gets one whole.
    parts = min(SLICES, share)
    order = Window.partitionBy("lang", F.pmod("h", F.lit(parts))).orderBy("h", "text")
    rows = rows.withColumn("_n", F.row_number().over(order))
    rows = rows.where(F.col("_n") <= -(-share // parts))
    return sorted((r.text, r.lang) for r in rows.select("text", "lang").collect())


def identify(docs: DataFrame, model, keep=("doc_id",)) -> DataFrame:
    """`keep` columns of every row, with lang_pred and score."""
    schema = docs.select(*keep).schema
    schema = schema.add("lang_pred", "string").add("score", "double")
    per_batch = int(docs.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))

    def predict(batches):
        net = Identifier(model) if model else None
        for part in joined(batches, "text", per_batch):
            text = part.column("text")
            names = np.full(len(text), UNKNOWN, object)
            score = np.zeros(len(text))
            letters = pc.match_substring_regex(text, r"\p{L}").fill_null(False)
            at = np.flatnonzero(letters.to_numpy(zero_copy_only=False))
            if net and len(at):
                p = _softmax(net.texts(text.take(pa.array(at))).astype(np.float64))
                best = p.argmax(1)
                names[at] = np.array(net.names, object)[best]
                score[at] = p[np.arange(len(at)), best]
            columns = [part.column(k) for k in keep]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(names, pa.string()), pa.array(score)],
                [*keep, "lang_pred", "score"],
            )

    columns = [*keep, *(["text"] if "text" not in keep else [])]
    return small_batches(docs.select(*columns)).mapInArrow(predict, schema)


def accepted(docs: DataFrame, least=0.4) -> DataFrame:
    """The rows whose language is recognised with a score of `least` or more."""
    found = identify(beside_text(docs), fit(sample(docs)), ["row", "text"])
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(
        *from_beside(docs.columns)
    )


def op7_language_id(spark, sf_dir):
    """The predicted language of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, fit(sample(docs)))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language_id": op7_language_id}
