"""Benchmark decontamination by templates.

Texts become token lists in which numbers, names (capitalised words within a
sentence, neighbouring ones as one) and units after a number are typed slots; other
tokens are lower-cased words. Windows of `WINDOW` tokens are hash-joined between
documents and benchmark items. Hits of one document, item and offset form an
alignment. It is a leak if its windows cover `LEAST` tokens of the item (or all but
one of a shorter one) and its slots are consistent: equal item values stand for equal
document values and unequal for unequal, as in a question with new numbers or
names. Everything is DataFrame code.

All windows are looked for. An alignment needs `LITERALS` words outside slots in what
it covers, or the very slot values of the item: a bare pattern of numbers is met
everywhere, the numbers themselves are not.

The search has two steps. Hashes of all windows of all documents meet the set of
benchmark hashes, which lists places and multiplies nothing. Slots are only built at
those places. There, windows of nothing but slots meet on their values; such windows
with other values are then looked up at the one place that an alignment found
otherwise puts them. So a text and an item full of numbers do not meet on all pairs of
places. Benchmark windows go to all executors up to `BROADCAST_WINDOWS`, places up to
`BROADCAST_ROWS`; more are joined by shuffle.

Defined results: null text counts as empty; items of fewer than `WINDOW` tokens are
never found; a null id is reported as null, each text of its own; repeated rows
count once, also repeated items of one id and text; a document that holds several
items gives a row for each; empty tables give no rows; other columns are ignored by
the search, kept by the filter.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.groups import computed_once, durable, same_join, skew_join
from .tables import table

WINDOW = 8
LITERALS = 5
LEAST = 13
BROADCAST_WINDOWS = 200_000
# Leaked documents to take away are sent to all executors up to this number.
BROADCAST_ROWS = 1_000_000

# The units that may follow a number.
UNITS = (
    "mm cm m km in ft mi mg g kg t lb lbs oz ml l dl s sec secs min mins h hr hrs hour hours "
    "day days week weeks month months year years second seconds minute minutes meter meters "
    "metre metres kilometer kilometers mile miles gram grams kilogram kilograms pound pounds "
    "dollar dollars cent cents euro euros percent degree degrees kmh mph hz khz mhz kb mb gb tb "
    "w kw v"
).split()

# The repeated groups are possessive: nothing after them needs a retry, and they are
# then matched in a loop, where a plain repeat takes stack for each of a thousand names.
NAME = r"([\p{Ll}0-9,;)][ \t\n])(\p{Lu}\p{Ll}+(?:[ \t\n]\p{Lu}\p{Ll}+)*+)"
TOKEN = r"\x01[^\x04]*\x04|[0-9]+(?:[.,:/][0-9]+)*+|\p{L}+"
# What a slot of each kind looks like in a template.
NUMBER, NAMED, UNIT = "<number>", "<name>", "<unit>"


def _tokens(rows: DataFrame) -> DataFrame:
    """Replace `text` by `raw` tokens and `canon` (slots typed)."""
    marked = F.regexp_replace(
        F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x01\x04]", " "),
        NAME,
        "$1\x01$2\x04",
    )
    rows = rows.withColumn("_marked", marked)
    rows = computed_once(rows, {"raw": F.regexp_extract_all("_marked", F.lit(TOKEN), F.lit(0))})
    number = lambda x: (x >= "0") & (x < ":")  # noqa: E731  begins with a digit
    units = F.array(*[F.lit(u) for u in UNITS])

    def typed(x, i):
        low = F.lower(x)
        after = (i > 0) & number(F.get(F.col("raw"), i - 1))
        return (
            F.when(F.startswith(x, F.lit("\x01")), NAMED)
            .when(number(x), NUMBER)
            .when(after & F.array_contains(units, low), UNIT)
            .otherwise(low)
        )

    return computed_once(rows.drop("_marked"), {"canon": F.transform("raw", typed)}).drop("text")


def _window(array, place):
    """The elements of a window. A slice would copy the whole array each time."""
    return [F.get(F.col(array), place + (k - 1)) for k in range(WINDOW)]


def _window_hashes(rows: DataFrame) -> DataFrame:
    """Tokens and `hashes`, one per window in order."""
    rows = computed_once(_tokens(rows), {"_hash": F.transform("canon", lambda t: F.xxhash64(t))})
    last = F.size("_hash") - WINDOW + 1
    places = F.when(last > 0, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(
        F.array().cast("array<int>")
    )
    hashes = F.transform(places, lambda i: F.xxhash64(*_window("_hash", i)))
    return rows.withColumn("hashes", hashes).drop("_hash")


def _slots_at(place):
    """Raw values of a window's slots, '' for other tokens, joined."""
    pairs = zip(_window("raw", place), _window("canon", place), strict=True)
    values = [F.when(F.startswith(c, F.lit("<")), r).otherwise("") for r, c in pairs]
    return F.array_join(F.array(*values), "\x02")


def _keyed(rows: DataFrame) -> DataFrame:
    """Add `bare` (a window of slots only) and `key`: its hash, for bare ones with values."""
    bare = ~F.array_contains(F.split("slots", "\x02"), "")
    key = F.when(F.col("bare"), F.xxhash64("hash", "slots")).otherwise(F.col("hash"))
    return rows.withColumn("bare", bare).withColumn("key", key)


def benchmark_windows(items: DataFrame) -> DataFrame:
    """All windows of the items: hash, key, bare, item_id, item_place, ..., and the
    places in the item of their words outside slots."""
    rows = _window_hashes(items.select("item_id", "text").distinct())
    made = F.transform(
        "hashes",
        lambda h, i: F.struct(
            h.alias("hash"), (i + 1).alias("item_place"), _slots_at(i + 1).alias("slots")
        ),
    )
    rows = rows.select("item_id", F.size("canon").alias("item_tokens"), F.explode(made).alias("w"))
    words = F.filter(
        F.transform(
            F.split("slots", "\x02"), lambda s, i: F.when(s == "", F.col("item_place") + i)
        ),
        lambda p: p.isNotNull(),
    )
    rows = _keyed(rows.select("item_id", "item_tokens", "w.*")).withColumn("item_words", words)
    return rows.withColumnRenamed("slots", "item_slots")


def _sent(rows: DataFrame, most: int) -> DataFrame:
    """Written rows, to be sent to all executors up to `most`, else to be merged."""
    rows = durable(rows)
    return F.broadcast(rows) if rows.count() <= most else rows.hint("merge")


VERSION = ["doc_id", "version"]


def _found_windows(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Windows of documents whose hash is a benchmark window's: place, slots, key, ..."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("version"), "text")
    known = _sent(bench.select("hash").distinct(), BROADCAST_WINDOWS)
    placed = _window_hashes(rows).select(*VERSION, F.posexplode("hashes").alias("place", "hash"))
    hits = placed.join(known, "hash", "left_semi")
    places = hits.groupBy(*VERSION).agg(
        F.array_distinct(F.collect_list(F.struct((F.col("place") + 1).alias("place"), "hash"))).alias("at")
    )
    places = durable(places)
    if places.count() <= BROADCAST_ROWS:
        texts = same_join(rows, F.broadcast(places), VERSION)
    else:
        texts = skew_join(rows, places, VERSION)
    made = F.transform(
        "at", lambda w: F.struct(w["place"].alias("place"), w["hash"].alias("hash"), _slots_at(w["place"]).alias("slots"))
    )
    return _keyed(_tokens(texts).select(*VERSION, F.explode(made).alias("w")).select(*VERSION, "w.*"))


def _aligned_windows(windows: DataFrame, bench: DataFrame) -> DataFrame:
    """Pairs of a document's and an item's window on one template, as far as the pair
    has a word outside slots, equal values, or an alignment with such a pair."""
    offset = (F.col("place") - F.col("item_place")).alias("offset")
    sides = ["item_id", "item_tokens", "item_place", "item_slots", "item_words", "slots"]
    item = bench.drop("hash", "bare")
    small = bench.count() <= BROADCAST_WINDOWS
    join = (lambda a, b, on: same_join(a, F.broadcast(b), on)) if small else skew_join
    pairs = join(windows, item, ["key"]).select(*VERSION, offset, *sides)
    bare = bench.where("bare").drop("key", "bare")
    if bare.isEmpty():
        return pairs
    pairs = durable(pairs)
    found = pairs.select(*VERSION, "offset", "item_id", "item_tokens").distinct()
    expected = join(found, bare, ["item_id", "item_tokens"]).withColumn(
        "place", F.col("item_place") + F.col("offset")
    )
    at = windows.where("bare").select(*VERSION, "place", "hash", "slots")
    met = skew_join(at, expected, VERSION + ["place", "hash"])
    return pairs.unionByName(met.select(*VERSION, "offset", *sides))


def _text_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Leaked items per document and text (`version`, its hash)."""
    bench = durable(benchmark_windows(items))
    pairs = F.filter(
        F.arrays_zip(
            F.split("item_slots", "\x02").alias("item"), F.split("slots", "\x02").alias("doc")
        ),
        lambda p: p["item"] != "",
    )
    covers = F.sequence(F.col("item_place"), F.col("item_place") + (WINDOW - 1))
    union = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    aligned = (
        _aligned_windows(durable(_found_windows(docs, bench)), bench)
        .groupBy(*VERSION, "item_id", "item_tokens", "offset")
        .agg(
            F.size(union(covers)).cast("long").alias("covered"),
            union(pairs).alias("pairs"),
            F.size(union("item_words")).alias("n_words"),
        )
    )
    verbatim = F.forall("pairs", lambda p: p["item"] == p["doc"])
    sides = [F.size(F.array_distinct(F.col("pairs")[side])) for side in ("item", "doc")]
    return (
        aligned.where(F.col("covered") >= F.least(F.lit(LEAST), F.col("item_tokens") - 1))
        .where((sides[0] == F.size("pairs")) & (sides[1] == F.size("pairs")))
        .where((F.col("n_words") >= LITERALS) | verbatim)
    )


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Leaked items per document: doc_id, item_id, covered, item_tokens, n_slots."""
    return (
        _text_leaks(docs, items)
        .groupBy("doc_id", "item_id")
        .agg(
            F.max("covered").alias("covered"),
            F.max(F.col("item_tokens").cast("long")).alias("item_tokens"),
            F.max(F.size("pairs").cast("long")).alias("n_slots"),
        )
    )


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` that have no leak, each judged by its own text."""
    found = _text_leaks(docs, items).select(
        F.col("doc_id").alias("_leaked"), F.col("version").alias("_version")
    )
    found = _sent(found.distinct(), BROADCAST_ROWS)
    same = F.col("doc_id").eqNullSafe(F.col("_leaked")) & (
        F.xxhash64("text") == F.col("_version")
    )
    return docs.join(found, same, "left_anti").select(*docs.columns)


def _sql_tokens(name, source, key):
    # The SQL engine's patterns never go back, and know no possessive repeat.
    token_sql, name_sql = (p.replace("*+", "*") for p in (TOKEN, NAME))
    units = ", ".join(f"'{u}'" for u in UNITS)
    return rf"""
{name}_raw as (
  select {key}, regexp_extract_all(regexp_replace(regexp_replace(coalesce(text, ''), '[\x01\x04]', ' ', 'g'),
      '{name_sql}', '\1' || chr(1) || '\2' || chr(4), 'g'), '{token_sql}') as raw
  from (select distinct {key}, text from {source})),
{name}_canon as (
  select {key}, raw, [case when starts_with(raw[i], chr(1)) then '<name>'
      when raw[i] >= '0' and raw[i] < ':' then '<number>'
      when i > 1 and raw[i - 1] >= '0' and raw[i - 1] < ':' and lower(raw[i]) in ({units}) then '<unit>'
      else lower(raw[i]) end for i in range(1, len(raw) + 1)] as canon from {name}_raw),
{name}_windows as (
  select {key}, len(canon) as n_tokens, place, array_to_string(canon[place:place + {WINDOW - 1}], ' ') as label,
    [case when starts_with(canon[i], '<') then raw[i] else '' end for i in range(place, place + {WINDOW})] as slots
  from (select *, unnest(range(1, len(canon) - {WINDOW} + 2)) as place from {name}_canon))"""


SQL = rf"""
with {_sql_tokens("doc", "(select doc_id, md5(coalesce(text, '')) as version, text from documents)", "doc_id, version")},
{_sql_tokens("item", "benchmark", "item_id")},
hits as (
  select d.doc_id, d.version, i.item_id, i.n_tokens as item_tokens, d.place - i.place as shift,
    i.place as item_place, i.slots as item_slots, d.slots as doc_slots
  from doc_windows d join item_windows i using (label)),
covers as (
  select doc_id, version, item_id, item_tokens, shift, count(distinct place) as covered,
    count(distinct place) filter (a = '') as n_words
  from (select *, unnest(range(item_place, item_place + {WINDOW})) as place, unnest(item_slots) as a
    from hits) group by all),
pairs as (
  select doc_id, version, item_id, item_tokens, shift, count(distinct (a, b)) as n,
    count(distinct a) as na, count(distinct b) as nb, bool_and(a = b) as verbatim
  from (select *, unnest(item_slots) as a, unnest(doc_slots) as b from hits) where a <> ''
  group by all)
select c.doc_id, c.item_id, max(covered)::bigint as covered, max(c.item_tokens)::bigint as item_tokens,
  max(coalesce(n, 0))::bigint as n_slots
from covers c left join pairs p on c.doc_id is not distinct from p.doc_id and c.version = p.version
  and c.item_id is not distinct from p.item_id and c.item_tokens = p.item_tokens and c.shift = p.shift
where covered >= least({LEAST}, c.item_tokens - 1) and coalesce(n = na and n = nb, true)
  and (n_words >= {LITERALS} or coalesce(verbatim, true))
group by c.doc_id, c.item_id
"""


def op4_decontamination(spark, sf_dir):
    """Benchmark items found in all documents, verbatim or with new parameters."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontamination": op4_decontamination}
ORACLES = {"op4_decontamination": SQL}
