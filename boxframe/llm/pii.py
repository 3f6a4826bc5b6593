"""Personal data by rules and a skip-chain conditional random field.

Rules give the base spans (email, ip, card, phone), which always stay. The field
labels the words that have a digit or an @ (all others are outside by definition)
with a kind or none. Neighbouring words are linked in a chain; words of one
document that are equal or similar (same letters and digits, same six digits or
more, an address and its local part) are linked over any distance, each to its next
occurrence, and share a potential. Words under base spans are observed. Loopy
sum-product messages over the whole document then carry labels to repeated mentions
that no rule covers, such as a phone number without its country code. A message is
sent again as long as what it depends on changes by more than `SETTLED`, so evidence
travels as far as the document goes, and texts that settle soon cost no more for
longer ones beside them. A message that keeps swinging (loops need not settle) is
damped more and more after `SWINGS` times, which ends it. Words whose
label has a marginal of `SURE` or more become added spans; neighbours join. The field runs on every text that has
a digit or an @, whether a rule found something in it or not.

The weights are fitted by pseudo-likelihood on base spans of a bounded sample:
`SAMPLE` texts that have a digit or an @ (lowest hash of id and text), a snippet of
`SNIPPET` characters each from a place the hash chooses.

Defined results: null and empty texts have no spans; offsets count code points, end
exclusive; equal texts get equal spans; a sample without base spans adds nothing; an
empty table gives no rows; other columns are kept or ignored as asked.
"""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import beside_text, bounded_sample, from_beside, slices, small_batches, table

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 2000
SNIPPET = 4096
SURE = 0.9
SETTLED = 1e-7
SWINGS = 400
CONTEXTS, SHAPES = 64, 512

# An address is found at its @: no other character of a pattern can precede it.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# A run of digits that fails from its first digit fails from every other one.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TELLING = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_EDGE = ".,;:!?\"'<>[]{}"


def _emails(text):
    done = 0
    for m in _DOMAIN.finditer(text):
        at, low = m.start(), m.start()
        # The local part goes back to the last character that cannot be in it.
        while low > done:
            back = max(done, low - 64)
            run = _LOCAL_END.search(text[back:low])
            if not run:
                break
            low -= len(run[0])
            if run.start():
                break
        if low < at:
            yield low, m.end()
            done = m.end()


def _luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text):
    """(kind number, start, end) by kind, then start."""
    found = []
    if "@" in text:
        found += [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def _hash(word, size):
    h = 2166136261
    for c in word[:64].encode("utf-8", "replace"):
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % size


_SHAPE = str.maketrans(
    {**{c: "9" for c in "0123456789"}, **{chr(c): "a" for c in range(97, 123)}, **{chr(c): "A" for c in range(65, 91)}}
)
_N_SINGLE = 24
N_FEATURES = _N_SINGLE + SHAPES + 2 * CONTEXTS


def _features(word, before, after):
    digits = len(_NOT_DIGIT.sub("", word))
    bucket = 0 if not digits else 1 if digits < 4 else 2 if digits < 7 else 3 if digits < 13 else 4 if digits < 20 else 5
    dots = min(word.strip(_EDGE).count("."), 4)
    letters = any(c.isalpha() for c in word)
    shape = re.sub(r"(.)\1{4,}", r"\1\1\1\1", word.strip(_EDGE).translate(_SHAPE)[:40])
    shape = re.sub(r"[aA]+", "a", shape)
    return [
        0,
        1 + bucket,
        7 + dots,
        12 + letters,
        14 + ("-" in word),
        16 + ("(" in word),
        18 + word.startswith("+"),
        20 + ("@" in word),
        22 + (letters and "=" in word),
        _N_SINGLE + _hash(shape, SHAPES),
        _N_SINGLE + SHAPES + _hash(before, CONTEXTS),
        _N_SINGLE + SHAPES + CONTEXTS + _hash(after, CONTEXTS),
    ]


def _keys(word):
    plain = word.strip(_EDGE + "()+-").lower()
    if len(plain) >= 4:
        yield plain
    digits = _NOT_DIGIT.sub("", word)
    if len(digits) >= 6 and digits != plain:
        yield digits
    if "@" in plain and len(plain.split("@")[0]) >= 4:
        yield plain.split("@")[0]


class Graph:
    """Words of several texts as nodes, with chain and skip edges."""

    def __init__(self):
        self.features, self.observed, self.place = [], [], []
        self.chain, self.skip = [], []

    def add(self, text, base, number=0):
        """The nodes of one text; `number` tells which text they are from."""
        last, seen = {}, -2
        at = 0
        spans = sorted((a, b, k) for k, a, b in base)
        words = list(_WORD.finditer(text))
        for i, m in enumerate(words):
            if not _TELLING.search(m[0]):
                continue
            node = len(self.features)
            before = words[i - 1][0].lower() if i else ""
            after = words[i + 1][0].lower() if i + 1 < len(words) else ""
            if _TELLING.search(before):
                before = "9"
            if _TELLING.search(after):
                after = "9"
            self.features.append(_features(m[0], before, after))
            while at < len(spans) and spans[at][1] <= m.start():
                at += 1
            label = 0
            for a, b, k in spans[at : at + 8]:
                if a < m.end() and b > m.start():
                    label = k + 1
                    break
            self.observed.append(label)
            self.place.append((number, m.start(), m.end(), i))
            if seen == i - 1:
                self.chain.append((node - 1, node))
            seen = i
            for key in _keys(m[0]):
                if key in last and last[key] != node:
                    self.skip.append((last[key], node))
                last[key] = node

    def arrays(self):
        edges = lambda e: np.array(e, np.int64).reshape(-1, 2)
        return (
            np.array(self.features, np.int64).reshape(-1, 12),
            np.array(self.observed, np.int64),
            edges(self.chain),
            edges(self.skip),
        )


N_LABELS = len(KINDS) + 1


def _unsettled(y, chain, skip):
    """Words outside base spans that repeat a word inside one, and what adjoins them:
    whether they belong to a mention is what the field is to tell, not to learn."""
    open_ = np.zeros(len(y), bool)
    for a, b in (skip.T, skip.T[::-1]):
        open_[b[(y[a] > 0) & (y[b] == 0)]] = True
    for _ in range(3):
        for a, b in (chain.T, chain.T[::-1]):
            open_[b[open_[a] & (y[b] == 0)]] = True
    return open_


def fit(texts, steps=200, seed=5):
    """Pseudo-likelihood weights from texts with their base spans; None without any."""
    graph = Graph()
    for text in texts:
        graph.add(text, base_spans(text))
    x, y, chain, skip = graph.arrays()
    if not y.any():
        return None
    rng = np.random.Generator(np.random.PCG64(seed))
    weights = {
        "words": np.zeros((N_FEATURES, N_LABELS)),
        "chain": np.zeros((N_LABELS, N_LABELS)),
        "skip": np.zeros((N_LABELS, N_LABELS)),
    }
    mean = {k: np.zeros_like(v) for k, v in weights.items()}
    square = {k: np.zeros_like(v) for k, v in weights.items()}
    target = np.eye(N_LABELS)[y]
    settled = ~_unsettled(y, chain, skip)
    chain = chain[settled[chain].all(1)]
    skip = skip[settled[skip].all(1)]
    for step in range(1, steps + 1):
        # Some features are left out, so that the links have to carry labels too.
        used = rng.random(x.shape) > 0.3
        z = np.zeros((len(y), N_LABELS))
        for j in range(x.shape[1]):
            z += weights["words"][x[:, j]] * used[:, j : j + 1]
        for name, e in (("chain", chain), ("skip", skip)):
            np.add.at(z, e[:, 1], weights[name][y[e[:, 0]]])
            np.add.at(z, e[:, 0], weights[name].T[y[e[:, 1]]])
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        d = (p / p.sum(1, keepdims=True) - target) * settled[:, None] / settled.sum()
        g = {k: 1e-5 * v for k, v in weights.items()}
        for j in range(x.shape[1]):
            np.add.at(g["words"], x[:, j], d * used[:, j : j + 1])
        for name, e in (("chain", chain), ("skip", skip)):
            np.add.at(g[name], y[e[:, 0]], d[e[:, 1]])
            np.add.at(g[name].T, y[e[:, 1]], d[e[:, 0]])
        g["skip"] = (g["skip"] + g["skip"].T) / 2
        for k in weights:
            mean[k] += 0.1 * (g[k] - mean[k])
            square[k] += 0.01 * (g[k] ** 2 - square[k])
            m, s = mean[k] / (1 - 0.9**step), square[k] / (1 - 0.99**step)
            weights[k] -= 0.1 * m / (np.sqrt(s) + 1e-8)
    return weights


def _normal(z):
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def marginals(weights, x, observed, chain, skip, rounds=None):
    """Loopy sum-product: label probabilities of all nodes at once, from messages that
    have settled, or after so many rounds."""
    z = np.zeros((len(x), N_LABELS))
    for j in range(x.shape[1]):
        z += weights["words"][x[:, j]]
    seen = np.flatnonzero(observed)
    z[seen] = -50.0
    z[seen, observed[seen]] = 0.0
    ends = np.concatenate([chain, skip])
    if len(ends):
        kind = np.concatenate([np.zeros(len(chain), int), np.ones(len(skip), int)])
        tables = np.stack([weights["chain"], weights["skip"]])
        # Each edge both ways: source, target, table, and the message against it.
        source = np.concatenate([ends[:, 0], ends[:, 1]])
        target = np.concatenate([ends[:, 1], ends[:, 0]])
        table = np.concatenate([tables[kind], tables[kind].transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(ends)) + len(ends), np.arange(len(ends))])
        message = np.zeros((len(source), N_LABELS))
        sent = np.zeros(len(source), np.int64)
        # The edges that leave a node lie together in `leaving`.
        leaving = np.argsort(source, kind="stable")
        first = np.searchsorted(source[leaving], np.arange(len(x) + 1))
        belief = z.copy()
        active = np.arange(len(source))
        while len(active) and rounds != 0:
            rounds = rounds and rounds - 1
            out = (belief[source[active]] - message[back[active]])[:, :, None] + table[active]
            top = out.max(1, keepdims=True)
            new = _normal(np.log(np.exp(out - top).sum(1)) + top[:, 0])
            share = 0.5 * 0.9 ** np.maximum(sent[active] - SWINGS, 0)
            change = share[:, None] * (new - message[active])
            message[active] += change
            sent[active] += 1
            np.add.at(belief, target[active], change)
            active = active[np.abs(change).max(1) > SETTLED]
            moved = np.unique(target[active])
            n = first[moved + 1] - first[moved]
            place = np.repeat(first[moved] - np.cumsum(n) + n, n) + np.arange(n.sum())
            active = np.union1d(active, leaving[place])
        z = z.copy()
        np.add.at(z, target, message)
    return np.exp(_normal(z))


def spans_of(weights, texts):
    """Per text, its base spans and its added spans, each (kind, start, end)."""
    base = [base_spans(t) if t else [] for t in texts]
    added = [[] for _ in texts]
    if weights is None:
        return base, added
    graph = Graph()
    for i, (text, spans) in enumerate(zip(texts, base, strict=True)):
        if text:
            graph.add(text, spans, i)
    if not graph.features:
        return base, added
    x, observed, chain, skip = graph.arrays()
    p = marginals(weights, x, observed, chain, skip)
    label = p.argmax(1)
    label[(p.max(1) < SURE) | (observed > 0)] = 0
    open_at = (-1, 0, -2)
    for node in np.flatnonzero(label).tolist():
        number, start, end, word = graph.place[node]
        text, kind = texts[number], int(label[node]) - 1
        while start < end and text[start] in _EDGE:
            start += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        if start == end:
            continue
        if open_at == (number, kind, word - 1):
            added[number][-1] = (kind, added[number][-1][1], end)
        else:
            added[number].append((kind, start, end))
        open_at = (number, kind, word)
    return base, added


SPAN = "array<struct<kind:int,start:int,end:int,base:boolean>>"
_SPAN = pa.list_(
    pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
)


def sample(docs: DataFrame, most=SAMPLE):
    """The bounded training sample: snippets of texts that have a digit or an @."""
    place = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - SNIPPET, F.lit(1)))
    rows = docs.where(F.col("text").rlike("[0-9@]")).select(
        F.xxhash64("doc_id", "text").alias("h"),
        F.substring("text", place.cast("int") + 1, F.lit(SNIPPET)).alias("text"),
    )
    return [text for _, text in bounded_sample(rows, most)]


def _searched(batches, weights):
    """Bounded parts of batches, the places and texts of the rows that were searched, and
    the spans of each, (kind, start, end, base) by kind, then start."""
    for batch in batches:
        for part in slices(batch, "text"):
            column = part.column("text")
            telling = pc.fill_null(pc.match_substring_regex(column, "[0-9@]"), False)
            at = np.flatnonzero(telling.to_numpy(zero_copy_only=False))
            texts = column.take(pa.array(at)).to_pylist()
            base, added = spans_of(weights, texts)
            found = [
                sorted([(*s, True) for s in b] + [(*s, False) for s in a])
                for b, a in zip(base, added, strict=True)
            ]
            yield part, at.tolist(), texts, found


def _fields(docs, keep):
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)


def find_spans(docs: DataFrame, weights, keep=("doc_id",)) -> DataFrame:
    """`keep` columns of every row, and `spans` by kind, then start."""

    def find(batches):
        for part, at, _, found in _searched(batches, weights):
            rows = [[] for _ in range(part.num_rows)]
            for i, spans in zip(at, found, strict=True):
                rows[i] = [dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in spans]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in keep], pa.array(rows, _SPAN)], [*keep, "spans"]
            )

    columns = [*keep, *(["text"] if "text" not in keep else [])]
    return small_batches(docs.select(*columns)).mapInArrow(find, f"{_fields(docs, keep)}, spans {SPAN}")


def mask_text(text, spans):
    """The text with its spans replaced, in one pass; overlapping ones become one."""
    parts, at = [], 0
    for start, end, kind in sorted((s[1], s[2], s[0]) for s in spans):
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def masked(docs: DataFrame) -> DataFrame:
    """Every row with its spans replaced by their kind in brackets.

    Spans that overlap become one, named for the first; `n_chars`, where there is
    one, follows the new text. A text is cut in the task that finds its spans, and
    goes there once: the other columns travel beside it.
    """
    rows = small_batches(beside_text(docs))
    weights = fit(sample(docs))

    def mask(batches):
        for part, at, texts, found in _searched(batches, weights):
            changed, new = np.zeros(part.num_rows, bool), []
            for i, text, spans in zip(at, texts, found, strict=True):
                if spans:
                    changed[i] = True
                    new.append(mask_text(text, spans))
            column = part.column("text")
            text = pc.replace_with_mask(column, pa.array(changed), pa.array(new, column.type))
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(changed), text], ["row", "changed", "text"]
            )

    out = rows.mapInArrow(mask, f"{_fields(rows, ['row'])}, changed boolean, text string")
    columns = {}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(F.col("changed"), F.length("text").cast(kind)).otherwise(
            F.col("row.n_chars")
        )
    return out.select(*from_beside(docs.columns, columns))


def _listed(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])),
        ",",
    )


def op1_personal_data(spark, sf_dir):
    """Personal data in all documents: base counts and digest, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_spans(docs, fit(sample(docs)))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_added"),
    )


QUERIES = {"op1_personal_data": op1_personal_data}
