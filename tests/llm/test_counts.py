import base64
import os
import re
from collections import Counter

import pytest

from boxframe.llm import counts
from boxframe.operators.groups import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = os.environ.get("TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"


def words(rows):
    out = Counter()
    for _, text, lang, source, _ in rows:
        out[source, lang] += len(WORD.findall(text or ""))
    return out


def read(spark, store, tokenizer="words-1"):
    rows = counts.totals(spark, store).where(f"tokenizer = '{tokenizer}'").collect()
    return {(r.source, r.lang): r.n_tokens for r in rows if r.n_tokens}


def test_batches_add_up_and_repeat_without_effect(spark, corpus, odd_rows):
    from pyspark.sql import functions as F

    store = scratch_path(spark, "test")
    docs = corpus(odd_rows, clashing=True)
    assert counts.commit(store, "1", counts.inserts(docs))
    assert read(spark, store) == {k: n for k, n in words(odd_rows).items() if n}
    some = docs.where("doc_id > 4")
    shorter = F.substring("text", 1, 10)
    assert counts.commit(store, "2", counts.revisions(some, shorter))
    after = [(i, t[:10] if i and i > 4 and t else t, a, b, c) for i, t, a, b, c in odd_rows]
    assert read(spark, store) == {k: n for k, n in words(after).items() if n}
    assert not counts.commit(store, "2", counts.revisions(some, shorter))
    assert not counts.commit(store, "1", counts.deletes(docs))
    assert read(spark, store) == {k: n for k, n in words(after).items() if n}
    assert counts.committed(spark, store, "2") and not counts.committed(spark, store, "3")
    packed = counts.compact(spark, store, scratch_path(spark, "test"))
    assert read(spark, packed) == read(spark, store)
    assert counts.commit(store, "3", counts.deletes(corpus([r for r in after])))
    assert counts.totals(spark, store).collect() == []


def test_empty_batches_and_changes_without_images(spark, corpus):
    store = scratch_path(spark, "test")
    assert counts.commit(store, "e", counts.inserts(corpus([])))
    assert counts.totals(spark, store).collect() == []
    none = counts.inserts(corpus([(1, "a b")])).selectExpr("before", "before as after")
    assert counts.delta(none).collect() == []


@pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary file")
def test_byte_pair_counts(spark, corpus):
    import tiktoken

    pattern = r"\p{L}+|\p{N}+|[^\p{L}\p{N}]"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    coder = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, "hello there, straße 12", "en", "a"), (2, None, "en", "a"), (3, "", "en", "a")]
    got = counts.delta(counts.inserts(corpus(rows)), {"bpe-1": counts.ranked_counter(RANKS, pattern)})
    assert [(r.n_docs, r.n_tokens) for r in got.collect()] == [(3, len(coder.encode_ordinary(rows[0][1])))]


def test_a_compacted_store_knows_its_batches(spark, corpus, odd_rows):
    store = scratch_path(spark, "test")
    docs = counts.inserts(corpus(odd_rows))
    assert counts.commit(store, "1", docs)
    packed = counts.compact(spark, store, scratch_path(spark, "test"))
    want = read(spark, packed)
    assert not counts.commit(packed, "1", docs) and read(spark, packed) == want
    assert counts.commit(packed, "2", docs)
    again = counts.compact(spark, packed, scratch_path(spark, "test"))
    assert not counts.commit(again, "1", docs) and not counts.commit(again, "2", docs)
    assert read(spark, again) == {k: 2 * n for k, n in want.items()}


def test_of_two_commits_at_once_one_counts(spark, corpus, odd_rows, monkeypatch):
    store = scratch_path(spark, "test")
    docs = counts.inserts(corpus(odd_rows))
    # Both look before either has ended.
    monkeypatch.setattr(counts, "committed", lambda *_: False)
    assert counts.commit(store, "1", docs)
    want = read(spark, store)
    assert not counts.commit(store, "1", docs) and read(spark, store) == want
