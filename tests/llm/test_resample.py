import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boxframe.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, target, percent=10, least=20, buckets=10_000, longest=1):
    """Rows of documents by a plain loop: doc_id, n_features, weight, score, rank."""

    def counted(text):
        words = WORD.findall((text or "").translate(FOLD))
        runs = [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
        return len(words), Counter(zlib.crc32(r.encode()) % buckets for r in runs)

    texts = [(r[0], *counted(r[1])) for r in docs]
    s, t = Counter(), Counter()
    for _, _, c in texts:
        s += c
    for text in target:
        t += counted(text)[1]
    n_s, n_t = s.total(), t.total()
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets))))
        for b in range(buckets)
    ]
    out = []
    for doc_id, n_words, c in texts:
        weight = sum(n * gain[b] for b, n in c.items())
        name = "" if doc_id is None else doc_id
        h = int(hashlib.sha256(f"2024:{name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, n_words, c.total(), weight, score, None])
    able = sorted(
        (r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2])
    )
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = rank
    return sorted(([r[0], *r[2:]] for r in out), key=repr)


def got(docs, target, **kw):
    rows = resample.resampled(docs, target, **kw)
    return sorted((list(r) for r in rows.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.fixture(scope="module")
def target(spark):
    texts = ["The fox and the DOG run.", None, "", "brown words, lazy words: brown"]
    return texts, spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.lists(st.integers(0, 129), max_size=300), min_size=1, max_size=6),
    st.lists(st.integers(-70_000, 70_000), min_size=130, max_size=130),
)
def test_bit_slices_give_the_plain_sums(texts, gain):
    gain = np.array(gain)
    ends = np.cumsum([0] + [len(t) for t in texts])
    dealt = np.array([b for t in texts for b in t], np.int64)
    weight = resample.bit_sliced_weights(dealt, ends, *resample.gain_planes(gain))
    assert weight.tolist() == [int(gain[t].sum()) if t else 0 for t in texts]


@pytest.mark.parametrize("longest,percent", [(1, 10), (2, 60)])
def test_rows_match_a_plain_loop(corpus, odd_rows, target, longest, percent):
    texts, items = target
    rows = odd_rows + [(100 + i, "fox dog word%d " % (i % 7) * (1 + i % 40)) for i in range(120)]
    rows += [(500 + i % 3, "same words here " * 9) for i in range(30)]
    want = plain(rows, texts, percent=percent, longest=longest)
    assert got(corpus(rows, clashing=True), items, percent=percent, longest=longest) == want
    assert sum(r[4] is not None for r in want) > 5


def test_other_block_sizes_and_forgotten_words(corpus, odd_rows, target, monkeypatch):
    want = plain(odd_rows, target[0])
    monkeypatch.setattr(resample, "ROWS", 3)
    known = resample._Buckets(10_000)
    monkeypatch.setattr(resample, "REMEMBERED", 2)
    words = [b"one", b"two", b"three", b"one", b"four"]
    assert [known[w] for w in words] == [zlib.crc32(w) % 10_000 for w in words] and len(known) <= 2
    assert got(corpus(odd_rows), target[1]) == want


def test_empty_tables(corpus, target, spark):
    assert got(corpus([]), target[1]) == []
    none = spark.createDataFrame([], "item_id long, text string")
    rows = [(1, "a b c " * 10), (2, None), (None, "")]
    assert got(corpus(rows), none, percent=100) == plain(rows, [], percent=100)
