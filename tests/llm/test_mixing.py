import math
from collections import Counter, defaultdict

from boxframe.llm import mixing


def water(sizes, weights, total):
    """Targets by sharing out again and again what is above twice a source's size."""
    held = {}
    while True:
        rest = [s for s in sizes if s not in held]
        left = total - sum(held.values())
        unit = left / sum(weights[s] for s in rest) if rest else 0
        over = [s for s in rest if unit * weights[s] >= 2 * sizes[s]]
        if not over:
            return held | {s: unit * weights[s] for s in rest}
        held |= {s: 2 * sizes[s] for s in over}


def test_targets_and_rates_match_repeated_sharing(corpus):
    docs = [(i, "w " * (1 + i % 7), None, "s%02d" % (i * i % 11)) for i in range(400)]
    docs += [(1000 + i, "w " * 50, None, "s00") for i in range(200)]
    got = mixing.mix(corpus(docs)).collect()
    sizes = Counter()
    for _, text, _, source in docs:
        sizes[source] += len(text.split())
    weights = dict(zip(sorted(sizes), (5, 2, 1) * 9, strict=False))
    want = water(sizes, weights, 1.5 * sum(sizes.values()))
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9)
        assert r.taken in (r["size"] * math.floor(r.rate), r["size"] * math.floor(r.rate + 1))
        assert r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert abs(sum(taken.values()) / (1.5 * sum(sizes.values())) - 1) < 0.1
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(corpus(docs)).collect()))


def test_rows_go_out_as_often_as_counted(corpus, odd_rows):
    docs = corpus(odd_rows, clashing=True)
    counted = Counter()
    for r in mixing.mix(docs).collect():
        counted[r.doc_id] += r.copies
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns + ["copy_"]
    assert Counter(r.doc_id for r in rows.collect()) == +counted
    assert {r["copy"] for r in rows.collect()} == {"own copy"}


def test_empty_table_and_sources_without_words(corpus):
    assert mixing.mix(corpus([])).collect() == []
    assert mixing.mixed_rows(corpus([])).collect() == []
    got = mixing.mix(corpus([(1, "", None, "a"), (2, None, None, None)])).collect()
    assert [(r.target, r.copies, r.taken) for r in got] == [(0.0, 1, 0)] * 2
