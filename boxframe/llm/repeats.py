"""Substring dedup: repeats of `SIZE` words found in prefix-partitioned suffix trees.

The suffixes are those of the documents' word sequences. A repeat of `SIZE` words
is an inner node of their tree at that depth or below, so the tree is built only
where it gets that deep, in groups that fit in memory:

1. Leaves are left out. The anchor of a suffix is the one with the least hash of the
   `PIECE`-word pieces of its first `SIZE` words (the first such). Suffixes that
   share these words share the anchor, so a suffix whose anchor occurs once in all
   texts is a leaf above that depth. Anchors are counted in groups by hash.
2. Suffixes are partitioned by a prefix of variable length. Those with the same first
   `PREFIXES[0]` words are counted; a prefix that more than `MOST` suffixes have is
   lengthened to the next of `PREFIXES`, and counted again, and at last to all `SIZE`
   words. A group holds whole prefixes, dealt by hash.
3. A group sorts its suffixes by path. Neighbours with a common path of `SIZE` words
   or more form the intervals of the deep inner nodes: all but the earliest suffix
   of an interval begin a repeat.
4. Words that repeats cover are cut from the texts.

`remove_repeats` needs the tree to depth `SIZE` only. `maximal_repeats` goes on below:
suffixes of nodes that can begin a maximal repeat (with different words before them)
are compared word by word to the end of their run of repeated windows; intervals of
their longest common prefixes are the inner nodes, and those with different words
before them are the maximal repeats. That function sends, for each such suffix, the
words up to its run's end; a text of many short repeats in one run costs their number
times its length. `remove_repeats` has no such term.

Documents are dealt to parts by a hash of the row. A part sends one suffix, its
earliest, for each distinct path, so a passage in a third of all rows is sent once per
part. Paths are 64-bit hashes compared together with 32 bits of the anchor's.

Defined results: null text counts as empty; a null id comes after all others; rows
with one id and equal windows at equal places keep both; a text of fewer than
`SIZE` words loses nothing; an empty table gives no rows; other columns are
ignored. One text must fit in a task's memory.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.groups import durable
from .tables import parts_for, table
from .words import Words, mix, sliding_min

SIZE = 20
PIECE = 8
# Words of a prefix; the next length where more than `MOST` suffixes begin with it.
PREFIXES = (2, 6, 12)
MOST = 1 << 18
# Text in a part, which one task works on with some twenty times that in arrays.
PART_BYTES = 4 << 20
LAST_ID = np.iinfo(np.int64).max

_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


class Windows:
    """The windows of a part's documents, ordered by id, with their anchors."""

    def __init__(self, docs: pa.Table, size=SIZE, piece=PIECE):
        docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.docs = docs
        self.ids = docs.column("doc_id").cast(pa.int64()).fill_null(LAST_ID).to_numpy()
        self.words = words = Words(docs.column("text"))
        pieces = words.runs(piece)
        place = np.arange(len(pieces), dtype=np.uint64)
        # Least hash, then first place.
        least = sliding_min((pieces & ~_LOW) | place, size - piece + 1)
        fit = words.whole_runs(size)
        self.row = np.repeat(np.arange(len(fit)), fit)
        self.pos = np.arange(len(self.row)) - np.repeat(np.cumsum(fit) - fit, fit)
        self.word = words.first[:-1][self.row] + self.pos
        self.anchor_at = (least[self.word] & _LOW).astype(np.int64)
        self.pieces = pieces
        self.size = size

    def anchors(self):
        """Distinct places of anchors, and for each window the number of its place."""
        new = np.ones(len(self.anchor_at), bool)
        new[1:] = self.anchor_at[1:] != self.anchor_at[:-1]
        keys = mix(self.pieces[self.anchor_at[new]])
        return keys, np.cumsum(new) - 1


def _part(keys, parts):
    return (((keys >> _HALF) * np.uint64(parts)) >> _HALF).astype(np.int64)


def _rows(part, parts, at=None):
    """Bounds of equal part numbers in a sorted array."""
    edges = np.searchsorted(part, np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edges)):
        yield int(p), int(edges[p]), int(edges[p + 1])


ANCHORS = pa.schema(
    [("part", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("twice", pa.binary())]
)
# What a part is told: its repeated anchors (depth 0), its prefixes to be lengthened.
MARKS = pa.schema([("bucket", pa.int32()), ("depth", pa.int32()), ("keys", pa.binary())])
# Earlier marks go with the counts, on their way back to the part (`counts` null).
COUNTS = pa.schema(
    [("part", pa.int32()), ("bucket", pa.int32()), ("depth", pa.int32())]
    + [(n, pa.binary()) for n in ("keys", "counts")]
)
SUFFIXES = pa.schema(
    [("part", pa.int32()), ("bucket", pa.int32())]
    + [(n, pa.binary()) for n in ("ids", "rows", "starts", "sizes", "tags", "labels", "lefts")]
)
FOUND = pa.schema(
    [("bucket", pa.int32())] + [(n, pa.binary()) for n in ("rows", "starts", "sizes")]
)
MEMBERS = pa.schema(
    [("bucket", pa.int32())] + [(n, pa.binary()) for n in ("rows", "starts", "diverse")]
)
PATHS = pa.schema(
    [
        ("part", pa.int32()),
        ("node", pa.int64()),
        ("path", pa.binary()),
        ("times", pa.int64()),
        ("left", pa.int64()),
        ("doc_id", pa.int64()),
        ("start", pa.int32()),
    ]
)
MAXIMAL = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("times", pa.int64())]
)
CUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("kept", pa.string()),
        ("repeats", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ]
)
_DDL = {
    "int32": "int",
    "int64": "bigint",
    "binary": "binary",
    "string": "string",
}


def _ddl(schema):
    return ", ".join(f"`{f.name}` {_DDL.get(str(f.type), 'array<struct<start:int,end:int>>')}" for f in schema)


def _make(schema, rows):
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _bucket(docs):
    return docs.column("bucket")[0].as_py() if docs.num_rows else None


def part_anchors(docs: pa.Table, parts) -> pa.Table:
    """A part's distinct anchors, and which of them it holds twice."""
    keys, _ = Windows(docs).anchors()
    keys, counts = np.unique(keys, return_counts=True)
    bucket, rows = _bucket(docs), []
    for p, low, high in _rows(_part(keys, parts), parts):
        twice = np.packbits(counts[low:high] > 1)
        rows.append((p, bucket, keys[low:high].tobytes(), twice.tobytes()))
    return _make(ANCHORS, rows)


def repeated_anchors(group: pa.Table) -> pa.Table:
    """To each part, those of its anchors that occur twice anywhere."""
    twice = [
        np.unpackbits(np.frombuffer(t, np.uint8), count=len(k) // 8) + 1
        for k, t in zip(
            group.column("keys").to_pylist(), group.column("twice").to_pylist(), strict=True
        )
    ]
    return _above(group, twice, 1, 0)


def frequent_prefixes(group: pa.Table, depth, most) -> pa.Table:
    """To each part, its earlier marks and its prefixes that more than `most` suffixes have."""
    earlier = group.filter(group.column("counts").is_null()).select(MARKS.names)
    group = group.filter(group.column("counts").is_valid())
    if not group.num_rows:
        return earlier.cast(MARKS)
    counts = [np.frombuffer(c, np.int32) for c in group.column("counts").to_pylist()]
    return pa.concat_tables([earlier.cast(MARKS), _above(group, counts, most, depth)])


def _above(group, counts, most, depth):
    """To each part, its keys whose counts add up to more than `most`."""
    buckets = group.column("bucket").to_pylist()
    keys = [np.frombuffer(k, np.uint64) for k in group.column("keys").to_pylist()]
    every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, np.concatenate(counts), len(every))
    more, rows, at = (total > most)[inverse], [], 0
    for bucket, k in zip(buckets, keys, strict=True):
        keep = more[at : at + len(k)]
        at += len(k)
        if keep.any():
            rows.append((bucket, depth, k[keep].tobytes()))
    return _make(MARKS, rows)


class Suffixes:
    """A part's suffixes under repeated anchors, and the earliest of each path."""

    def __init__(self, docs: pa.Table, marks: pa.Table):
        self.marks = {0: [], **{d: [] for d in PREFIXES}}
        for depth, keys in zip(
            marks.column("depth").to_pylist(), marks.column("keys").to_pylist(), strict=True
        ):
            self.marks[depth].append(np.frombuffer(keys, np.uint64))
        self.marks = {d: np.concatenate([np.zeros(0, np.uint64), *k]) for d, k in self.marks.items()}
        self.windows = w = Windows(docs)
        keys, of = w.anchors()
        at = np.flatnonzero(np.isin(keys, self.marks[0])[of])
        self.word, self.row, self.pos = w.word[at], w.row[at], w.pos[at]
        self.ids = w.ids[self.row]
        self.label = w.words.runs(w.size)[self.word]
        self.tag = (keys[of[at]] & _LOW).astype(np.uint32)
        # They are in the order of id and place, so a stable sort keeps the earliest first.
        order = np.lexsort((self.tag, self.label))
        same = np.zeros(len(order), bool)
        a, b = order[1:], order[:-1]
        same[1:] = (self.label[a] == self.label[b]) & (self.tag[a] == self.tag[b])
        lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        self.lead = np.empty(len(order), np.int64)
        self.lead[order] = lead
        # Rows of one id are ordered by text, so a lead may have a later place than another.
        first = self.ids[self.lead]
        self.later = (self.ids > first) | ((self.ids == first) & (self.pos > self.pos[self.lead]))

    def prefixes(self, which, depths=PREFIXES):
        """Hashes of the prefixes, and the suffixes whose prefixes are longer than `depths`."""
        longer = np.ones(len(which), bool)
        prefix = self.label[which].copy()
        for depth in depths:
            key = self.windows.words.runs(depth)[self.word[which]]
            prefix[longer] = key[longer]
            longer &= np.isin(key, self.marks[depth])
            if not longer.any():
                break
        prefix[longer] = self.label[which][longer]
        return mix(prefix), longer

    def lefts(self):
        """The word before, as a hash; 0 at the beginning of a text."""
        return np.where(self.pos > 0, self.windows.words.hash[self.word - 1] | np.uint64(1), np.uint64(0))


def part_prefixes(docs: pa.Table, marks: pa.Table, parts, level) -> pa.Table:
    """How many of a part's suffixes have each prefix, of those to be lengthened so far."""
    bucket, told = _bucket(docs), set(marks.column("depth").to_pylist())
    forward = [
        (bucket % parts, bucket, depth, keys, None)
        for depth, keys in zip(
            marks.column("depth").to_pylist(), marks.column("keys").to_pylist(), strict=True
        )
    ]
    if 0 not in told or (level and PREFIXES[level - 1] not in told):
        return _make(COUNTS, forward)
    s = Suffixes(docs, marks)
    which = np.flatnonzero(~s.later)
    which = which[s.prefixes(which, PREFIXES[:level])[1]]
    keys = s.windows.words.runs(PREFIXES[level])[s.word[which]]
    keys, counts = np.unique(keys, return_counts=True)
    return _make(
        COUNTS,
        forward
        + [
            (p, bucket, None, keys[low:high].tobytes(), _bytes(counts[low:high], np.int32))
            for p, low, high in _rows(_part(keys, parts), parts)
        ],
    )


def part_suffixes(docs: pa.Table, marks: pa.Table, parts, lefts=False) -> pa.Table:
    """A part's suffixes under repeated anchors: the earliest of each path for the group
    of its prefix; later ones are repeats already (`labels` null), in runs. With the words
    before them on request, 0 where these differ."""
    if not marks.num_rows:
        return _make(SUFFIXES, [])
    s, bucket, rows = Suffixes(docs, marks), _bucket(docs), []
    gone = np.flatnonzero(s.later)
    if len(gone):
        first, size = _runs(s.row[gone], s.pos[gone])
        y = gone[first]
        found = (_bytes(s.row[y], np.int32), _bytes(s.pos[y], np.int32), _bytes(size, np.int32))
        rows.append((bucket % parts, bucket, None, *found, None, None, None))
    left = s.lefts()
    if lefts:
        left[s.lead[left != left[s.lead]]] = 0
    which = np.flatnonzero(~s.later)
    part = _part(s.prefixes(which)[0], parts)
    which = which[np.argsort(part, kind="stable")]
    part = np.sort(part, kind="stable")
    for p, low, high in _rows(part, parts):
        x = which[low:high]
        rows.append(
            (
                p,
                bucket,
                _bytes(s.ids[x], np.int64),
                _bytes(s.row[x], np.int32),
                _bytes(s.pos[x], np.int32),
                None,
                _bytes(s.tag[x], np.uint32),
                _bytes(s.label[x], np.uint64),
                _bytes(left[x], np.uint64) if lefts else None,
            )
        )
    return _make(SUFFIXES, rows)


def _bytes(values, kind):
    return np.ascontiguousarray(values, kind).tobytes()


def _runs(row, pos):
    """First index and length of runs of neighbouring windows."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1)
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(row)))


class Tree:
    """A group's suffixes sorted by path; `first` is where a suffix's interval begins."""

    def __init__(self, data, own):
        take = lambda name, kind: np.concatenate(
            [np.frombuffer(data[name][i], kind) for i in own]
        )
        sizes = [len(data["labels"][i]) // 8 for i in own]
        self.edges = np.cumsum([0, *sizes])
        self.ids, self.row, self.pos = (
            take("ids", np.int64), take("rows", np.int32), take("starts", np.int32)
        )
        label, tag = take("labels", np.uint64), take("tags", np.uint32)
        self.order = order = np.lexsort((self.pos, self.ids, tag, label))
        new = np.ones(len(order), bool)
        a, b = order[1:], order[:-1]
        new[1:] = (label[a] != label[b]) | (tag[a] != tag[b])
        self.first = np.flatnonzero(new)
        self.node = np.cumsum(new) - 1


def deep_nodes(group: pa.Table) -> pa.Table:
    """All suffixes but the earliest of each deep inner node, as repeats of their parts."""
    data = group.to_pydict()
    rows, own = [], []
    for i, labels in enumerate(data["labels"]):
        if labels is None:
            rows.append((data["bucket"][i], data["rows"][i], data["starts"][i], data["sizes"][i]))
        else:
            own.append(i)
    if own:
        t = Tree(data, own)
        lead = t.order[t.first][t.node]
        later = np.zeros(len(t.order), bool)
        later[t.order] = (t.ids[t.order] != t.ids[lead]) | (t.pos[t.order] != t.pos[lead])
        for i, low, high in zip(own, t.edges[:-1], t.edges[1:], strict=True):
            x = low + np.flatnonzero(later[low:high])
            if len(x):
                x = x[np.lexsort((t.pos[x], t.row[x]))]
                first, size = _runs(t.row[x], t.pos[x])
                y = x[first]
                rows.append(
                    (data["bucket"][i], _bytes(t.row[y], np.int32), _bytes(t.pos[y], np.int32), _bytes(size, np.int32))
                )
    return _make(FOUND, rows)


def node_members(group: pa.Table) -> pa.Table:
    """The suffixes of deep inner nodes, and whether the words before them differ. A part
    is told of suffixes that it alone has too; it knows how often."""
    data = group.to_pydict()
    own = [i for i, labels in enumerate(data["labels"]) if labels is not None]
    if not own:
        return _make(MEMBERS, [])
    t = Tree(data, own)
    left = np.concatenate([np.frombuffer(data["lefts"][i], np.uint64) for i in own])[t.order]
    low, high = np.minimum.reduceat(left, t.first), np.maximum.reduceat(left, t.first)
    size = np.diff(np.append(t.first, len(t.order)))
    diverse, several = np.zeros(len(t.order), np.uint8), np.zeros(len(t.order), np.uint8)
    diverse[t.order] = ((low == 0) | (low != high))[t.node]
    several[t.order] = (size > 1)[t.node]
    flags, rows = diverse + 2 * several, []
    for i, a, b in zip(own, t.edges[:-1], t.edges[1:], strict=True):
        x = a + np.flatnonzero(flags[a:b])
        if len(x):
            told = (_bytes(t.row[x], np.int32), _bytes(t.pos[x], np.int32), flags[x].tobytes())
            rows.append((data["bucket"][i], *told))
    return _make(MEMBERS, rows)


def part_paths(docs: pa.Table, told: pa.Table, parts) -> pa.Table:
    """The suffixes that can begin a maximal repeat, to the ends of their runs of repeated
    windows, once for each distinct sequence of words."""
    marks = told.filter(told.column("diverse").is_null())
    members = told.filter(told.column("diverse").is_valid())
    if not members.num_rows:
        return _make(PATHS, [])
    s = Suffixes(docs, marks)
    size, n = s.windows.size, len(s.row)
    join = lambda name, kind: np.concatenate(
        [np.frombuffer(b, kind) for b in members.column(name).to_pylist()]
    )
    # Suffixes are sorted by row and place; find those that the groups told of.
    spot = (s.row.astype(np.int64) << 32) | s.pos
    at = np.searchsorted(spot, (join("rows", np.int32).astype(np.int64) << 32) | join("starts", np.int32))
    flags = np.zeros(n, np.uint8)
    flags[at] = join("diverse", np.uint8)
    times = np.bincount(s.lead, minlength=n)
    flags = flags | flags[s.lead]
    repeated = (flags & 2 > 0) | (times[s.lead] > 1)
    begins = repeated & (flags & 1 > 0)
    after = np.ones(n, bool)
    after[:-1] = (spot[1:] != spot[:-1] + 1) | ~repeated[1:]
    ends = np.flatnonzero(after)
    end = s.word[ends[np.searchsorted(ends, np.arange(n))]] + size
    words, left = s.windows.words.hash, s.lefts()
    found = {}
    for i in np.flatnonzero(begins).tolist():
        key = (int(s.label[i].view(np.int64)), words[s.word[i] : end[i]].astype(">u8").tobytes())
        now = found.get(key)
        before, place = int(left[i].view(np.int64)), (int(s.ids[i]), int(s.pos[i]))
        if now is None:
            found[key] = (1, before, *place)
        else:
            found[key] = (now[0] + 1, before if before == now[1] else 0, *min(now[2:], place))
    spread = lambda node: int(_part(mix(np.array([node], np.int64).view(np.uint64)), parts)[0])
    return _make(PATHS, [(spread(node), node, path, *v) for (node, path), v in found.items()])


def lcp_intervals(paths):
    """Intervals (depth, low, high) of sorted byte strings of 8-byte words, inner nodes of
    their tree; equal neighbours meet at their whole length."""
    stack, out = [(0, 0)], []
    for i in range(1, len(paths) + 1):
        depth = _common(paths[i - 1], paths[i]) if i < len(paths) else -1
        low = i - 1
        while stack and stack[-1][0] > depth:
            top, low = stack.pop()
            out.append((top, low, i))
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, low))
    return out


def _common(a, b):
    n = min(len(a), len(b)) // 8
    differ = np.flatnonzero(np.frombuffer(a, np.uint64, n) != np.frombuffer(b, np.uint64, n))
    return int(differ[0]) if len(differ) else n


def maximal(group: pa.Table) -> pa.Table:
    """Inner nodes with different words before their suffixes, of each node of the group."""
    rows = sorted(
        zip(*(group.column(c).to_pylist() for c in PATHS.names[1:]), strict=True), key=lambda r: r[:2]
    )
    # A path that occurs several times is an inner node itself.
    rows = [r for r in rows for _ in range(1 + (r[2] > 1))]
    share = [r[2] - 1 if i and rows[i - 1] is r else 1 for i, r in enumerate(rows)]
    out, at = [], 0
    while at < len(rows):
        stop = at
        while stop < len(rows) and rows[stop][0] == rows[at][0]:
            stop += 1
        for depth, low, high in lcp_intervals([r[1] for r in rows[at:stop]]):
            here = rows[at + low : at + high]
            if depth >= SIZE and high - low > 1 and (len({r[3] for r in here}) > 1 or here[0][3] == 0):
                doc_id, start = min(r[4:] for r in here)
                out.append((doc_id, start, depth, sum(share[at + low : at + high])))
        at = stop
    return _make(MAXIMAL, out)


def cut_repeats(docs: pa.Table, found: pa.Table, size=SIZE) -> pa.Table:
    """The documents of a part without the words that repeats cover."""
    docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    join = lambda name: np.concatenate(
        [np.zeros(0, np.int32)] + [np.frombuffer(b, np.int32) for b in found.column(name).to_pylist()]
    )
    row, start, length = join("rows"), join("starts"), join("sizes")
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    end = start + length[order] + size - 1
    edges = np.searchsorted(row, np.arange(docs.num_rows + 1))
    out = []
    for i, (doc_id, text) in enumerate(
        zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), strict=True)
    ):
        words = (text or "").encode().split()
        spans = []
        for a, b in zip(start[edges[i] : edges[i + 1]].tolist(), end[edges[i] : edges[i + 1]].tolist(), strict=True):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(b, spans[-1][1])
            else:
                spans.append([a, b])
        n = len(words)
        for a, b in reversed(spans):
            del words[a:b]
        out.append((doc_id, n, b" ".join(words).decode(), [{"start": a, "end": b} for a, b in spans]))
    return _make(CUT, out)


def _dealt(docs, most):
    """Documents with their part as `bucket`, the number of parts, and what parts are told."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = parts_for(docs, part_bytes=PART_BYTES)
    bucket = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int")
    dealt = docs.withColumn("bucket", bucket)
    anchors = dealt.groupBy("bucket").applyInArrow(
        lambda t: part_anchors(t, parts), _ddl(ANCHORS)
    )
    marks = anchors.groupBy("part").applyInArrow(repeated_anchors, _ddl(MARKS))
    for level in range(len(PREFIXES)):
        marks = _counted(dealt, marks, parts, level, most)
    return dealt, parts, marks


def _counted(dealt, marks, parts, level, most):
    """The marks with those of prefixes of one more length."""
    depth = PREFIXES[level]
    counts = (
        dealt.groupBy("bucket")
        .cogroup(marks.groupBy("bucket"))
        .applyInArrow(lambda t, m: part_prefixes(t, m, parts, level), _ddl(COUNTS))
    )
    return counts.groupBy("part").applyInArrow(
        lambda t: frequent_prefixes(t, depth, most), _ddl(MARKS)
    )


def remove_repeats(docs: DataFrame, most=MOST) -> DataFrame:
    """doc_id, n_words, the kept words as `kept`, and the removed word ranges as
    `repeats` (start, end exclusive), for every document."""
    dealt, parts, marks = _dealt(docs, most)
    suffixes = (
        dealt.groupBy("bucket")
        .cogroup(marks.groupBy("bucket"))
        .applyInArrow(lambda t, m: part_suffixes(t, m, parts), _ddl(SUFFIXES))
    )
    found = suffixes.groupBy("part").applyInArrow(deep_nodes, _ddl(FOUND))
    return (
        dealt.groupBy("bucket")
        .cogroup(found.groupBy("bucket"))
        .applyInArrow(lambda t, f: cut_repeats(t, f), _ddl(CUT))
    )


def maximal_repeats(docs: DataFrame, most=MOST) -> DataFrame:
    """Every sequence of `SIZE` words or more that occurs twice or more and would occur less
    often with a word more on either side: its first place (doc_id, start), size and times."""
    dealt, parts, marks = _dealt(docs, most)
    marks = durable(marks)
    suffixes = (
        dealt.groupBy("bucket")
        .cogroup(marks.groupBy("bucket"))
        .applyInArrow(lambda t, m: part_suffixes(t, m, parts, lefts=True), _ddl(SUFFIXES))
    )
    members = suffixes.groupBy("part").applyInArrow(node_members, _ddl(MEMBERS))
    told = marks.unionByName(members, allowMissingColumns=True)
    paths = (
        dealt.groupBy("bucket")
        .cogroup(told.groupBy("bucket"))
        .applyInArrow(lambda t, m: part_paths(t, m, parts), _ddl(PATHS))
    )
    repeats = paths.groupBy("part").applyInArrow(maximal, _ddl(MAXIMAL))
    return repeats.withColumn("doc_id", F.nullif("doc_id", F.lit(LAST_ID)))


SQL = r"""
with split as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents),
windows as (
  select doc_id, words, unnest(range(1, len(words) - 18)) as place from split
  where len(words) >= 20),
labelled as (
  select doc_id, place, array_to_string(words[place:place + 19], ' ') as label from windows),
later as (
  select doc_id, place from (
    select doc_id, place, row_number() over (partition by label order by doc_id, place) as n
    from labelled) where n > 1),
covered as (
  select distinct doc_id, unnest(range(place, place + 20)) as place from later),
single as (
  select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as place from split),
kept as (
  select doc_id, string_agg(word, ' ' order by place) as text from single
  anti join covered using (doc_id, place) group by doc_id),
gone as (select doc_id, count(*) as n from covered group by doc_id)
select doc_id, len(words)::bigint as n_words, coalesce(gone.n, 0)::bigint as n_removed,
  sha256(coalesce(kept.text, '')) as kept_sha256
from split left join kept using (doc_id) left join gone using (doc_id)
"""


def op10_repeats(spark, sf_dir):
    """All documents without words that a window begun earlier already has."""
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("repeats", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return cut.select(
        "doc_id",
        "n_words",
        removed.alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {"op10_repeats": op10_repeats}
ORACLES = {"op10_repeats": SQL}
