"""License scans by an exact set-similarity join of text blocks and templates.

Words are runs of characters other than ASCII ones that are no letter or digit, with
A-Z in lower case. A text is cut into blocks of twice a template's length (rounded up
to a power of two), each beginning half a block after the last, so that a passage as
long as the template lies whole in one of them. A block meets a template if it holds
`THRESHOLD` of the template's distinct words; all such blocks are found:

  * tokens are ordered by the number of texts that have them, rarest first, counted
    over all documents; tokens outside templates cannot add to an overlap and are
    left out of the order;
  * prefix: if n tokens of a set must be shared, one of its first size - n + 1 is. A
    block and a template meet on equal tokens of both prefixes, by hash join;
  * length: a block with fewer tokens of templates than must be shared is left out;
  * positions: what can still follow a shared token on either side, and precede it,
    must add up to the overlap;
  * the overlap itself is then counted.

Blocks without any token of a template's prefix are left out before their tokens are
ordered. Everything is DataFrame code, and all rows but the blocks that meet a template
stay where they were read. Templates are few and given by the caller; those of one
length class are searched together, as long as they have `VOCABULARY` words at most.

Apart from that, phrases are found where their words stand consecutively.

Defined results: null text counts as empty and an empty text has no words, places or
labels; a text is judged by itself, so repeated rows decide alike and a null id is kept;
an empty table gives no rows; other columns are ignored; templates without words are
left out.
"""

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.groups import durable, same_join, skew_join
from .tables import table

THRESHOLD = 0.9
VOCABULARY = 4096
# Texts with labels that are sent to all executors; more are joined by shuffle.
BROADCAST_ROWS = 200_000

# Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# The wording of common notices.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at",
    ),
    (
        "apache",
        "Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
    ),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either version "
        "3 of the License, or (at your option) any later version.",
    ),
    ("mit", "Released under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files (the Software), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy "
        "of the MPL was not distributed with this file, You can obtain one at",
    ),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text):
    """Words of a template."""
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def spaced(text):
    """A text's words with one space before, between and behind them; ' ' if none."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), BETWEEN, " ")


def _count(text, character=" "):
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def _tokens(line):
    """The words of a spaced text as an array; one empty word if there are none."""
    return F.split(F.trim(line), " ")


def _literal(words):
    return F.array(*[F.lit(w) for w in words]) if words else F.expr("cast(array() as array<string>)")


def phrase_places(line, phrase):
    """How often a phrase stands in a spaced text, and its first and last word there.

    The text is cut before each place, so the spaces in the parts tell the words.
    """
    parts = F.split(line, f"(?<= )(?={re.escape(phrase)} )")
    found = F.contains(line, F.lit(f" {phrase} "))
    last = _count(line) - _count(F.element_at(parts, -1))
    return F.struct(
        F.when(found, F.size(parts) - 1).otherwise(0).cast("long").alias("n"),
        F.when(found, _count(F.get(parts, F.lit(0))) - 1).cast("long").alias("first"),
        F.when(found, last - 1).cast("long").alias("last"),
    )


def with_phrases(rows: DataFrame, phrases=PHRASES) -> DataFrame:
    """Replace `line` by n_words, n_base, first_word, last_word and base (labels)."""
    words = [(" ".join(_words(p)), label) for p, label in phrases]
    rows = rows.withColumns(
        {f"_p{i}": phrase_places(F.col("line"), p) for i, (p, _) in enumerate(words)}
    )
    of = lambda field: [F.col(f"_p{i}.{field}") for i in range(len(words))]
    nothing = F.lit(None).cast("long")
    labels = [F.when(n > 0, label) for n, (_, label) in zip(of("n"), words, strict=True)]
    return rows.withColumns(
        {
            "n_words": F.greatest(_count(F.col("line")) - 1, F.lit(0)).cast("long"),
            "n_base": sum(of("n"), F.lit(0).cast("long")),
            "first_word": F.least(*of("first"), nothing, nothing),
            "last_word": F.greatest(*of("last"), nothing, nothing),
            "base": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels))))
            if labels
            else _literal([]),
        }
    ).drop("line", *[f"_p{i}" for i in range(len(words))])


def _classes(templates):
    """Templates (label, words) by length class, in batches of bounded vocabulary."""
    by_class = {}
    for label, text in templates:
        words = _words(text)
        if words:
            by_class.setdefault(1 << (len(words) - 1).bit_length(), []).append((label, set(words)))
    for step, some in sorted(by_class.items()):
        batch, seen = [], set()
        for label, words in some:
            if batch and len(seen | words) > VOCABULARY:
                yield step, batch
                batch, seen = [], set()
            batch.append((label, words))
            seen |= words
        yield step, batch


def _ordered(lines: DataFrame, vocabulary):
    """The words, by the number of texts that have them, over all texts; then by name."""
    often, words = {}, sorted(vocabulary)
    for at in range(0, len(words), VOCABULARY):
        some = F.array_intersect(_literal(words[at : at + VOCABULARY]), _tokens(F.col("line")))
        counts = lines.select(F.explode(some).alias("word")).groupBy("word").count()
        often |= {r.word: r["count"] for r in counts.collect()}
    return sorted(words, key=lambda w: (often.get(w, 0), w))


def _needed(size, threshold):
    # Rounded, so that 0.9 of 10 is 9.
    return max(1, math.ceil(round(threshold * size, 9)))


def _index(batches, rank, threshold):
    """A row per template and token of its prefix; and those tokens per batch."""
    rows, prefixes = [], [set() for _ in batches]
    for number, (_, batch) in enumerate(batches):
        for label, words in batch:
            ranked = sorted(words, key=rank.get)
            needed = _needed(len(ranked), threshold)
            for place, word in enumerate(ranked[: len(ranked) - needed + 1]):
                prefixes[number].add(word)
                row = {
                    "batch": F.lit(number),
                    "token": F.lit(word),
                    "label": F.lit(label),
                    "t_place": F.lit(place),
                    "size": F.lit(len(ranked)),
                    "needed": F.lit(needed),
                    "t_tokens": _literal(ranked),
                }
                rows.append(F.struct(*[c.alias(n) for n, c in row.items()]))
    return rows, prefixes


def _blocks(step, number):
    begins = F.sequence(F.lit(0), F.size("words") - 1, F.lit(step))

    def words(i):
        # Word by word: a slice would copy the whole text for each block.
        last = F.least(i + 2 * step, F.size("words")) - 1
        return F.transform(F.sequence(i, last), lambda j: F.get(F.col("words"), j))

    return F.transform(
        begins, lambda i: F.struct(F.lit(number).alias("batch"), i.alias("block"), words(i).alias("words"))
    )


def _by_batch(values):
    """One value per batch number, evaluated only for its own blocks."""
    out = F.when(F.col("b.batch") == 0, values[0])
    for number, value in enumerate(values[1:], 1):
        out = out.when(F.col("b.batch") == number, value)
    return out


def block_matches(lines: DataFrame, templates=TEMPLATES, threshold=THRESHOLD) -> DataFrame:
    """Blocks of spaced texts that meet a template: the columns of `lines` but the text,
    and label, block (its first word, from 0), overlap and size (of the template).

    A block may meet several templates, and a template by several tokens: rows repeat.
    """
    batches = list(_classes(templates))
    order = _ordered(lines, set().union(*[w for _, batch in batches for _, w in batch]))
    rank = {w: i for i, w in enumerate(order)}
    rows, prefixes = _index(batches, rank, threshold)
    index = lines.sparkSession.range(1).select(F.inline(F.array(*rows)))
    keep = [c for c in lines.columns if c != "line"]
    texts = lines.select(*keep, _tokens(F.col("line")).alias("words")).where(
        F.arrays_overlap("words", _literal(sorted(set().union(*prefixes))))
    )
    cut = F.flatten(F.array(*[_blocks(step, n) for n, (step, _) in enumerate(batches)]))
    blocks = texts.select(*keep, F.explode(cut).alias("b")).where(
        _by_batch([F.arrays_overlap("b.words", _literal(sorted(p))) for p in prefixes])
    )
    # The order of the first array is kept: tokens come rarest first.
    own = [sorted(set().union(*[w for _, w in batch]), key=rank.get) for _, batch in batches]
    blocks = blocks.select(
        *keep,
        "b.batch",
        "b.block",
        _by_batch([F.array_intersect(_literal(words), F.col("b.words")) for words in own]).alias("tokens"),
    )
    shared = blocks.select(
        *keep, "batch", "block", "tokens", F.posexplode("tokens").alias("place", "token")
    ).join(F.broadcast(index), ["batch", "token"])
    have = F.size("tokens")
    after = F.least(have - F.col("place"), F.col("size") - F.col("t_place"))
    return (
        shared.where(have >= F.col("needed"))
        .where(F.col("place") <= have - F.col("needed"))
        .where(F.least("place", "t_place") + after >= F.col("needed"))
        .withColumn("overlap", F.size(F.array_intersect("tokens", "t_tokens")))
        .where(F.col("overlap") >= F.col("needed"))
        .select(*keep, "label", "block", "overlap", "size")
    )


def scanned(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold=THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base (labels of
    phrases), found (labels of templates), containment (the largest, or 0)."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("version"), spaced(F.col("text")).alias("line"))
    rows = with_phrases(lines, phrases)
    if not any(_words(text) for _, text in templates):
        return rows.drop("version").withColumns({"found": _literal([]), "containment": F.lit(0.0)})
    matches = block_matches(lines, templates, threshold)
    per_text = durable(
        matches.groupBy("doc_id", "version").agg(
            F.array_sort(F.collect_set("label")).alias("found"),
            F.max(F.col("overlap") / F.col("size")).alias("containment"),
        )
    )
    keys = ["doc_id", "version"]
    if per_text.count() <= BROADCAST_ROWS:
        rows = same_join(rows, F.broadcast(per_text), keys, "left")
    else:
        rows = skew_join(rows, per_text, keys, "left")
    return rows.drop("version").withColumns(
        {
            "found": F.coalesce("found", _literal([])),
            "containment": F.coalesce("containment", F.lit(0.0)),
        }
    )


def op11_licences(spark, sf_dir):
    """License labels of all documents, by phrases and by templates."""
    rows = scanned(table(spark, sf_dir, "documents"))
    labels = F.array_sort(F.array_union("base", "found"))
    return rows.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.col("containment")).alias("score"),
    )


def _sql():
    listed = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
    phrases = ", ".join(f"({listed(_words(p))}, '{label}')" for p, label in PHRASES)
    templates = ", ".join(
        f"({1 << (len(_words(t)) - 1).bit_length()}, {n}, '{label}', {listed(sorted(set(_words(t))))})"
        for n, (label, t) in enumerate(TEMPLATES)
    )
    return rf"""
with texts as (
  select row_number() over () as id, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    '{UPPER}', '{LOWER}'), '{WORD}') as words from documents),
phrases(phrase, label) as (values {phrases}),
templates(step, number, label, tokens) as (values {templates}),
begun as (select id, unnest(words) as word, unnest(range(len(words))) as place from texts),
places as (
  select id, place, label from begun join phrases on word = phrase[1] join texts using (id)
  where words[place + 1:place + len(phrase)] = phrase),
base as (
  select id, count(*) as n, min(place) as low, max(place) as high,
    list_sort(list(distinct label)) as labels from places group by id),
blocks as (
  select id, step, words[b + 1:b + 2 * step] as part
  from (select id, step, words, unnest(range(0, len(words), step)) as b
    from texts, (select distinct step from templates))),
shares as (
  select id, label, len(list_intersect(tokens, part)) as n, len(tokens) as size
  from blocks join templates using (step)),
found as (
  select id, list_sort(list(distinct label)) as labels, max(n::double / size) as share
  from shares where n >= ceil(round({THRESHOLD} * size, 9)) group by id)
select doc_id, len(words)::bigint as n_words, coalesce(base.n, 0)::bigint as n_base,
  low::bigint as first_word, high::bigint as last_word,
  coalesce(array_to_string(base.labels, ','), '') as base_labels,
  array_to_string(list_sort(list_distinct(coalesce(base.labels, []) || coalesce(found.labels, []))), ',') as labels,
  case when base.n > 0 then 1.0::double else coalesce(share, 0.0::double) end as score
from texts left join base using (id) left join found using (id)
"""


QUERIES = {"op11_licences": op11_licences}
ORACLES = {"op11_licences": _sql()}
