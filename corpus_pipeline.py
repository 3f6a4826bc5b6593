"""From raw documents to a training mix, in five stages that can each be rerun.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet in the shared folder and read again as the next one's documents. All but the
last return the columns of `documents`. Each operator's module states what it does
with nulls, empty and long texts, ties, repeated rows and empty tables.
"""

from boxframe.llm import langid, mixing, near, pii, templates
from boxframe.llm.tables import table
from boxframe.operators.groups import durable

# Near duplicates of the pipeline share so many percent of their shingles, or more.
NEAR_PERCENT = 80


def recognised(spark, docs, sf_dir):
    """Documents whose language is recognised; texts without letters go."""
    return langid.accepted(docs)


def deduplicated(spark, docs, sf_dir):
    """One document of each group of near duplicates: the one with the smallest id."""
    return near.one_of_each(docs, NEAR_PERCENT)


def decontaminated(spark, docs, sf_dir):
    """Documents that hold no benchmark item, verbatim or with new parameters."""
    return templates.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def anonymised(spark, docs, sf_dir):
    """All documents, with personal data replaced by its kind."""
    return pii.masked(docs)


def mixed(spark, docs, sf_dir):
    """Each document as often as its source's target asks, numbered by `copy`."""
    return mixing.mixed_rows(docs)


STAGES = [
    ("language ID", recognised),
    ("MinHash near-dedup", deduplicated),
    ("benchmark decontamination", decontaminated),
    ("PII", anonymised),
    ("mixing", mixed),
]
# A trained network cannot be written in SQL; tests/llm holds run() against plain loops.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage over all of `documents`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
