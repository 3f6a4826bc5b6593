"""COCO documents of any size, cut at byte ranges.

A COCO file is one JSON document. Spark's text reader cuts it at every `}`, so a
long file is read by many tasks, block by block. Whether a piece begins inside a
string, and how deep, follows from counts: quotes and brackets are summed per block,
the sums of the blocks before are added, and running sums inside the block give the
rest. An object of a list ends where the depth is back at 2. The text is read twice, once
for the sums and once for the objects, each time by narrow tasks: pieces are not
shuffled, but for the few objects that two blocks share.

Defined results: objects that Spark cannot read by the schema of their list, objects
longer than `most` bytes, images or annotations without an id (or image id), and whole documents
whose brackets or quotes do not match are returned as rejects with the reason; in
such a document the objects before the fault are kept, but for one that may be cut
off. Keys other than `images` and `annotations` are passed over; if one of these comes
twice, both lists are read. Ids are those of their document.
A text between two `}` is one row, so it must fit a task.
"""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.groups import computed_once, durable
from .files import coco_labels

IMAGE = "id bigint, file_name string, width int, height int"
ANNOTATION = "id bigint, image_id bigint, category_id int, bbox array<double>"
SECTIONS = ("images", "annotations")
# Longest object, in bytes, that is put together from pieces.
MOST = 1 << 24
# Most tasks that write documents.
MOST_TASKS = 4096
BLOCK = ["doc", "block"]


@dataclass
class Coco:
    """The lists of COCO documents, with the document of each row, and what was rejected."""

    images: DataFrame
    annotations: DataFrame
    rejects: DataFrame


def _count(text, mark):
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _pieces(spark, path):
    """Texts between closing braces; a block of a file is read by one task, in order."""
    files = spark.read.option("lineSep", "}").text(path)
    return files.select(
        F.url_decode("_metadata.file_path").alias("doc"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("piece"),
    )


def _measured(pieces):
    """Adds the quotes of a piece, and what its brackets add to the depth if it begins
    outside of a string (`bare`) and if all of it counts (`brackets`): a piece that begins
    inside of one adds the difference."""
    # Without what is escaped, every quote begins or ends a string.
    plain = F.regexp_replace("piece", r"(?s)\\.", "")
    bare = F.regexp_replace("plain", r'"[^"]*+("|\z)', "")
    opens = lambda c: _count(c, "{") + _count(c, "[") - _count(c, "]")
    return (
        pieces.withColumn("plain", plain)
        .withColumns({"bare": bare, "quotes": _count("plain", '"'), "brackets": opens("plain")})
        .withColumns({"bare": opens("bare"), "bytes": F.octet_length("piece") + 1})
        .drop("plain")
    )


def _stretches(batch):
    """(first, end) of the rows of a batch that are of one block of a file."""
    doc, block = batch["doc"], batch["block"]
    if not len(block):
        return []
    other = pc.or_(pc.not_equal(doc[1:], doc[:-1]), pc.not_equal(block[1:], block[:-1]))
    edges = [0, *(np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1).tolist(), len(block)]
    return zip(edges, edges[1:])


def _numbers(batch, names, first, end):
    return [batch[n][first:end].to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def _change(quotes, bare, brackets, before):
    """(begins in a string, ends outside of one, change of depth) of pieces in order, with
    `before` quotes ahead of them."""
    after = before + np.cumsum(quotes)
    quoted, closed = (after - quotes) % 2 == 1, after % 2 == 0
    return quoted, closed, np.where(quoted, brackets - bare, bare) - closed


# Quotes of a block, and for a block that begins outside (0) and inside (1) of a string the
# sum of its changes of depth, the lowest sum ahead of the last piece's, and whether that
# piece ends outside of a string.
TOTALS = (
    "doc string, block long, size long, pieces long, bytes long, quotes long, "
    "sum0 long, low0 long, closed0 boolean, sum1 long, low1 long, closed1 boolean"
)


def _totals(batches):
    """One row of TOTALS for each block; its pieces come in order, in one task."""
    names = [f.split()[0] for f in TOTALS.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(f.split()[0], types[f.split()[1]]) for f in TOTALS.split(", ")])
    here = None
    for batch in batches:
        done = []
        for first, end in _stretches(batch):
            at = tuple(batch[c][first].as_py() for c in ("doc", "block", "size"))
            if here is None or (here["doc"], here["block"]) != at[:2]:
                if here is not None:
                    done.append(here)
                here = dict(zip(names, (*at, 0, 0, 0, 0, None, False, 0, None, False), strict=True))
            quotes, bare, brackets, size = _numbers(batch, ("quotes", "bare", "brackets", "bytes"), first, end)
            for k in (0, 1):
                _, closed, change = _change(quotes, bare, brackets, here["quotes"] + k)
                after = here[f"sum{k}"] + np.cumsum(change)
                lows = [here[f"low{k}"], here[f"sum{k}"] if here["pieces"] else None, *after[:-1].tolist()]
                here[f"low{k}"] = min((x for x in lows if x is not None), default=None)
                here[f"sum{k}"], here[f"closed{k}"] = int(after[-1]), bool(closed[-1])
            here["pieces"] += end - first
            here["bytes"] += int(size.sum())
            here["quotes"] += int(quotes.sum())
        yield pa.RecordBatch.from_pylist(done, schema=schema)
    if here is not None:
        yield pa.RecordBatch.from_pylist([here], schema=schema)


def _blocks(totals):
    """Per block the quotes and the depth before it, and whether its last piece has no
    brace at its end (`open`) or may be cut off (`cut`)."""
    line = Window.partitionBy("doc").orderBy("block")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("doc")
    inside = F.col("odd") == 1
    of = lambda name: F.when(inside, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    blocks = totals.withColumns(
        {
            "odd": F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2,
            "last": F.col("block") == F.max("block").over(whole),
            # The last piece of a file that does not end with a brace has none.
            "open": F.sum("bytes").over(whole) > F.col("size"),
        }
    )
    blocks = blocks.withColumn("open", F.col("open") & F.col("last"))
    blocks = blocks.withColumn("change", of("sum") + (F.col("open") & of("closed")).cast("long"))
    blocks = blocks.withColumns(
        {
            "depth": F.coalesce(F.sum("change").over(before), F.lit(0)),
            "low": F.least(of("low"), "change"),
            "quoted": (F.col("odd") + F.col("quotes")) % 2 == 1,
        }
    )
    bad = (F.col("last") & ((F.col("depth") + F.col("change") != 0) | F.col("quoted"))) | (
        F.col("depth") + F.col("low") < 0
    )
    # The last piece of a document that is cut off may be cut off itself.
    cut = F.col("last") & F.bool_or(bad).over(whole)
    return blocks.select(*BLOCK, "pieces", "odd", "depth", "open", cut.alias("cut"))


def _heads(depth, quoted, piece):
    """(key, start) of a piece: the list that a piece opens ('' for what is no list), and
    where the first object of a list begins, counted from 0."""
    at, key, name, colon, listed, opened = 0, None, None, False, depth == 2, None
    end = len(piece)
    if quoted:
        at = _string_end(piece, 0)
    while at < end:
        c = piece[at]
        if c == '"':
            after = _string_end(piece, at + 1)
            if depth == 1 and not colon:
                name = piece[at + 1 : after - 1]
            at = after
            continue
        if c == ":":
            colon = True
        elif c == ",":
            colon = False
        elif c in "[{":
            if depth == 1:
                listed = c == "["
                key = name if listed else ""
            elif depth == 2 and c == "{" and listed:
                opened = at
                break
            depth, colon = depth + 1, False
        elif c == "]":
            depth, colon = depth - 1, False
        at += 1
    return key, opened


def _string_end(text, at):
    """The place after the quote that ends a string."""
    while at < len(text):
        if text[at] == "\\":
            at += 2
        elif text[at] == '"':
            return at + 1
        else:
            at += 1
    return len(text)


# Where a list goes on, the next object begins after a comma.
_NEXT = re.compile(r"[ \t\r\n]*,?[ \t\r\n]*\{")
# Rows found in a block: an object, one that is too long, the end, a middle and the
# beginning of an object of several blocks, and the last list that the block opens.
WHOLE, LONG, END, MIDDLE, BEGIN, KEY = range(6)
FOUND = pa.schema(
    [
        ("doc", pa.string()),
        ("block", pa.int64()),
        ("kind", pa.int32()),
        ("section", pa.string()),
        ("bytes", pa.int64()),
        ("text", pa.string()),
    ]
)


class _Block:
    """Goes through the pieces of a block in order and puts its objects together.

    A section is None where the block has not said yet which list it is in."""

    def __init__(self, at, left, quotes, depth, most):
        self.at, self.left, self.quotes, self.depth, self.most = at, left, quotes, depth, most
        self.key, self.section, self.begun = None, None, False
        # Texts of the object that is not ended yet; the block may begin inside of one.
        self.parts, self.bytes = ([] if depth > 2 else None), 0

    def _row(self, kind, section, text=None):
        return (*self.at, kind, section, self.bytes, text)

    def read(self, pieces, sizes, quotes, bare, brackets, is_open, cut):
        out = []
        quoted, closed, change = _change(quotes, bare, brackets, self.quotes)
        self.left -= len(pieces)
        if is_open and not self.left and closed[-1]:
            closed[-1], change[-1] = False, change[-1] + 1
        after = self.depth + np.cumsum(change)
        ends = closed & (after == 2)
        if cut and not self.left:
            ends[-1] = False
        depth = (after - change).tolist()
        for piece, size, at, inside, end in zip(
            pieces, sizes.tolist(), depth, quoted.tolist(), ends.tolist(), strict=True
        ):
            start = None
            if at <= 2:
                follows = _NEXT.match(piece) if at == 2 and not inside else None
                if follows:
                    start = follows.end() - 1
                else:
                    key, start = _heads(at, inside, piece)
                    self.key = self.key if key is None else key
            if start is not None:
                if end:
                    self.bytes, self.parts = size, None
                    out.append(self._row(WHOLE, self.key, piece[start:] + "}"))
                    continue
                self.parts, self.bytes, self.section, self.begun = [piece[start:]], size, self.key, True
            elif self.parts is not None:
                self.bytes += size
                # Of an object that is too long only the bytes are kept.
                if self.bytes > self.most:
                    self.parts = []
                else:
                    self.parts.append(piece)
            if end and self.parts is not None:
                text = "}".join(self.parts) + "}" if self.parts else None
                kind = END if not self.begun else WHOLE if self.bytes <= self.most else LONG
                out.append(self._row(kind, self.section, text))
                self.parts = None
        self.quotes, self.depth = int(self.quotes + quotes.sum()) % 2, int(after[-1])
        return out

    def finish(self):
        out = []
        if self.parts is not None and self.bytes:
            text = "}".join(self.parts) + "}" if self.parts else None
            out.append(self._row(BEGIN if self.begun else MIDDLE, self.section, text))
        if self.key is not None:
            out.append(self._row(KEY, self.key))
        return out


def _finder(most):
    """A pass over pieces, with their measures and the state of their block, to FOUND."""

    def table(out):
        columns = list(zip(*out, strict=True)) or [()] * len(FOUND)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND
        )

    def find(batches):
        here = None
        for batch in batches:
            out = []
            for first, end in _stretches(batch):
                at = (batch["doc"][first].as_py(), batch["block"][first].as_py())
                left, odd, depth, is_open, cut = (
                    batch[c][first].as_py() for c in ("pieces", "odd", "depth", "open", "cut")
                )
                if here is None or here.at != at:
                    out += here.finish() if here else []
                    here = _Block(at, left, odd, depth, most)
                numbers = _numbers(batch, ("bytes", "quotes", "bare", "brackets"), first, end)
                out += here.read(batch["piece"][first:end].to_pylist(), *numbers, is_open, cut)
            yield table(out)
        if here:
            yield table(here.finish())

    return find


def _found(pieces, blocks, most):
    """Rows of FOUND; pieces stay where they are read, as blocks have one small row each."""
    kinds = "doc string, block long, kind int, section string, bytes long, text string"
    return pieces.join(F.broadcast(blocks), BLOCK).mapInArrow(_finder(most), kinds)


def _objects(found, blocks, most):
    """(texts of objects by document and section, objects that are too long)."""
    keys = found.where(F.col("kind") == KEY).select(*BLOCK, F.col("section").alias("_key"))
    before = Window.partitionBy("doc").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.last("_key", ignorenulls=True).over(before)
    ahead = blocks.select(*BLOCK).join(keys, BLOCK, "left").select(*BLOCK, ahead.alias("_key"))
    found = (
        found.where(F.col("kind") != KEY)
        .join(F.broadcast(ahead.where("_key is not null")), BLOCK, "left")
        .withColumn("section", F.coalesce("section", "_key"))
        .where(F.col("section").isin(*SECTIONS))
        .drop("_key")
    )
    whole = found.where(F.col("kind") == WHOLE).select("doc", "section", "text")
    # At most two parts of a block are of objects that other blocks share.
    line = Window.partitionBy("doc").orderBy("block", "kind")
    begin = F.last(F.when(F.col("kind") == BEGIN, F.col("block")), ignorenulls=True).over(line)
    key = ["doc", "section", "begin"]
    parts = found.where(F.col("kind").isin(END, MIDDLE, BEGIN))
    placed = parts.select(*BLOCK, "kind", "section", "bytes", begin.alias("begin"))
    sizes = (
        placed.where("begin is not null")
        .groupBy(*key)
        .agg(F.sum("bytes").alias("bytes"), F.bool_or(F.col("kind") == END).alias("whole"))
        .where("whole")
    )
    fits = sizes.where(F.col("bytes") <= most).select(*key)
    joined = (
        parts.join(placed.drop("section", "bytes"), [*BLOCK, "kind"])
        .join(fits, key, "left_semi")
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
        .select("doc", "section", F.array_join(F.col("parts.text"), "").alias("text"))
    )
    long = found.where(F.col("kind") == LONG).select("doc", "section")
    long = long.unionByName(sizes.where(F.col("bytes") > most).select("doc", "section"))
    return whole.unionByName(joined), long


def _rejected(rows, reason, text=None):
    kind = F.lit(None).cast("string")
    section = F.col("section") if "section" in rows.columns else kind
    return rows.select(
        "doc",
        section.alias("section"),
        F.lit(reason).alias("reason"),
        (kind if text is None else F.col(text)).alias("text"),
    )


def read_documents(spark, path, most=MOST) -> Coco:
    """Images and annotations of all documents under a path, and rejects."""
    pieces = _measured(_pieces(spark, path))
    measures = [*BLOCK, "bytes", "quotes", "bare", "brackets"]
    blocks = durable(_blocks(pieces.select("size", *measures).mapInArrow(_totals, TOTALS)))
    texts, long = _objects(durable(_found(pieces.select("piece", *measures), blocks, most)), blocks, most)
    faulty = blocks.where("cut").select("doc")
    found, rejects = [], [_rejected(faulty, "unbalanced"), _rejected(long, "long")]
    for section, schema, needed in zip(
        SECTIONS, (IMAGE, ANNOTATION), (["id"], ["id", "image_id"]), strict=True
    ):
        fields = f"{schema}, _bad string"
        options = {"columnNameOfCorruptRecord": "_bad"}
        # Read once: the row is tested and taken apart.
        rows = computed_once(
            texts.where(F.col("section") == section),
            {"row": F.from_json("text", fields, options)},
        )
        missing = F.lit(False)
        for name in needed:
            missing = missing | F.col("row")[name].isNull()
        bad = F.col("row").isNull() | F.col("row._bad").isNotNull()
        rejects += [
            _rejected(rows.where(bad), "json", "text"),
            _rejected(rows.where(~bad & missing), "id", "text"),
        ]
        found.append(rows.where(~bad & ~missing).select("doc", "row.*").drop("_bad"))
    out = rejects[0]
    for more in rejects[1:]:
        out = out.unionByName(more)
    return Coco(*found, out)


def read_labels(spark, path, offset=0, most=MOST):
    """(label boxes with their document, rejects) of COCO files of any size."""
    coco = read_documents(spark, path, most)
    return coco_labels(coco.images, coco.annotations, offset, by=["doc"]), coco.rejects


def write_documents(images: DataFrame, annotations: DataFrame, path) -> None:
    """Write COCO documents, one below `path` for each value of `doc` in the two tables.

    A document is written by one task, row by row from rows that are sorted once; there are
    about as many tasks as documents, so a task's rows are bounded by a few documents.
    """
    spark = images.sparkSession
    docs = durable(images.select("doc").unionByName(annotations.select("doc")).distinct())
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(docs.count(), MOST_TASKS))

    def rows(table, part):
        body = F.to_json(F.struct(*[c for c in table.columns if c != "doc"]))
        return table.select("doc", F.lit(part).alias("part"), F.col("id").alias("at"), body.alias("value"))

    marks = F.inline(
        F.array(
            F.struct(F.lit(0).alias("part"), F.lit('{"images":[').alias("value")),
            F.struct(F.lit(2).alias("part"), F.lit('],"annotations":[').alias("value")),
            F.struct(F.lit(4).alias("part"), F.lit("]}").alias("value")),
        )
    )
    marks = docs.select("doc", marks).select("doc", "part", F.lit(None).cast("bigint").alias("at"), "value")
    lines = rows(images, 1).unionByName(rows(annotations, 3)).unionByName(marks)
    order = ["doc", "part", "at", "value"]
    lines = lines.repartition(tasks, "doc").sortWithinPartitions(*order)
    # A comma before every object of a list but the first.
    first = Window.partitionBy("doc", "part").orderBy("at", "value")
    comma = F.when(F.col("part").isin(1, 3) & (F.row_number().over(first) > 1), ",").otherwise("")
    # The order stays in view, so that the write sorts no second time.
    lines = lines.withColumn("text", F.concat(comma, "value")).sortWithinPartitions(*order)
    lines.select("doc", F.col("text").alias("value")).write.partitionBy("doc").text(path)
