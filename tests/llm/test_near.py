import random
import re

import numpy as np
import pyarrow as pa

from boxframe.llm import near

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def members(text):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def components(rows):
    """Smallest id reachable by links, by comparing every pair."""
    sets = {i: members(t) for i, t, *_ in rows if i is not None}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}, sets


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def group(n, edits, rng, length=150):
    """Near copies of one text, and copies of copies, so links form chains."""
    base = [f"b{rng.randrange(10**6)}" for _ in range(length)]
    texts = [" ".join(base)]
    for _ in range(n):
        source = texts[0] if rng.random() < 0.5 else rng.choice(texts)
        texts.append(edited(source.split(), rng.randrange(edits), rng))
    return texts


def corpus_rows():
    rng = random.Random(7)
    texts = []
    for n, edits in ((60, 5), (40, 9), (3, 2), (2, 2), (1, 3)):
        texts += group(n, edits, rng)
    texts += [texts[0]] * 20 + [texts[5].upper(), "  ".join(texts[6].split())]
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(80)) for _ in range(60)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def check(corpus, rows, **kw):
    want, sets = components(rows)
    got = near.near_groups(corpus(rows, **kw)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)
            assert r.n_shingles == len(sets[r.doc_id])


def test_components_equal_all_pairs(corpus):
    check(corpus, corpus_rows())


def test_small_blocks_give_the_same(corpus, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_ROWS", 7)
    check(corpus, corpus_rows())


def test_sets_fetched_by_shuffle_give_the_same(corpus, monkeypatch):
    monkeypatch.setattr(near, "BROADCAST_IDS", 0)
    check(corpus, corpus_rows()[:120])


def test_odd_rows(corpus, odd_rows):
    check(corpus, [r for r in odd_rows if r[0] != 1] + [odd_rows[0]], clashing=True)
    got = near.near_groups(corpus(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    assert near.near_groups(corpus([])).collect() == []
    docs = corpus(odd_rows, clashing=True)
    rows = near.one_of_each(docs)
    # The long text has the shingles of the first one.
    assert rows.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in rows.collect()) == [-1, -1, 1, 1, 2, 3, 4, 6, 7, 8, 9]


def test_one_of_each_group_stays(corpus):
    rows = corpus_rows()
    want, _ = components(rows)
    got = near.one_of_each(corpus(rows)).collect()
    assert sorted(r.doc_id for r in got) == sorted(set(want.values()))


def test_odd_sketch_estimates_the_share_of_equal_samples():
    rng = np.random.default_rng(8)
    for share in (0.85, 0.95):
        a = rng.integers(0, 2**32, (300, near.SAMPLES), dtype=np.uint32)
        b = np.where(rng.random(a.shape) < share, a, rng.integers(0, 2**32, a.shape, dtype=np.uint32))
        x, y = near.odd_sketches(a).view(np.uint64), near.odd_sketches(b).view(np.uint64)
        d = np.bitwise_count(x ^ y).sum(1)
        assert (d > near.most_bits()).mean() < 0.005
        estimate = 1 + near.BITS / (4 * near.SAMPLES) * np.log(1 - 2 * d / near.BITS)
        assert abs(estimate.mean() - share) < 0.01


def test_minima_are_those_of_each_text():
    column = pa.array(["a b c d e f g", "", None, "one", "a b c d e f g h i j"])
    values, bounds = near.shingles(column)
    assert bounds.tolist() == [0, 3, 3, 3, 4, 10]
    edges = np.array([0, 3, 4, 10])
    got = near.minima(values, edges, chunk=2)
    h = (values >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for i in range(3):
            part = h[edges[i] : edges[i + 1]]
            assert (got[i] == ((part[:, None] ^ near._XOR) * near._MUL).min(0)).all()


def test_lower_threshold_equals_all_pairs(corpus):
    rows = corpus_rows()
    _, sets = components(rows)
    want = {i: {i} for i in sets}
    for i in sets:
        for j in range(i):
            a, b = sets[i], sets[j]
            if want[i] is not want[j] and 100 * len(a & b) >= 80 * len(a | b):
                want[i] |= want[j]
                for k in want[i]:
                    want[k] = want[i]
    got = {r.doc_id: r.component_id for r in near.near_groups(corpus(rows), 80).collect()}
    assert got == {i: min(g) for i, g in want.items()}
    at_85 = {r.component_id for r in near.near_groups(corpus(rows)).collect()}
    assert len(set(got.values())) < len(at_85)


def test_bands_bring_pairs_of_the_lower_threshold_together():
    assert (1 - 0.8**near.ROWS) ** near.BANDS < 1e-4
    assert near.BANDS * near.ROWS <= near.SAMPLES
