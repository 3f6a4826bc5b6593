import random
import re

import numpy as np
import pyarrow as pa
import pytest

from boxframe.llm import repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut(rows, size=20):
    """Kept words per row, by looking at every window in the order of id and place."""
    first = {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    split = [WORD.findall(t or "") for _, t, *_ in rows]
    ident = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    for i in order:
        w = split[i]
        for p in range(len(w) - size + 1):
            key = tuple(w[p : p + size])
            first[key] = min(first.get(key, (*ident(i), p)), (*ident(i), p))
    out = []
    for i, w in enumerate(split):
        gone = set()
        for p in range(len(w) - size + 1):
            if first[tuple(w[p : p + size])] < (*ident(i), p):
                gone.update(range(p, p + size))
        out.append((rows[i][0], len(w), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=repr)


def check(corpus, rows, **kw):
    got = repeats.remove_repeats(corpus(rows, **kw)).collect()
    assert sorted(((r.doc_id, r.n_words, r.kept) for r in got), key=repr) == cut(rows)
    for r in got:
        assert sum(s.end - s.start for s in r.repeats) == r.n_words - len(r.kept.split())


def some_rows(n=120):
    rng = random.Random(9)
    word = lambda k: rng.choice("abcdefghij") * rng.randint(1, k)
    common = [" ".join(word(9) for _ in range(k)) for k in (19, 20, 21, 45, 200)]
    rows = []
    for i in range(n):
        parts = [" ".join(word(30) for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(common), " ".join(word(30) for _ in range(rng.randint(0, 25)))]
        if i % 9 == 0:
            parts.append("na " * rng.randint(15, 60))
        rows.append((i * 3, rng.choice([" ", "\n", " \t "]).join(parts)))
    rows += [(1000 + i, rows[i][1]) for i in range(15)]
    return rows


def test_kept_words_equal_plain_windows(corpus):
    check(corpus, some_rows())


@pytest.mark.parametrize("most", [0, 3])
def test_longer_prefixes_give_the_same(corpus, most):
    rows = some_rows(60)
    got = repeats.remove_repeats(corpus(rows), most=most).collect()
    assert sorted(((r.doc_id, r.n_words, r.kept) for r in got), key=repr) == cut(rows)


def arrow(rows):
    return pa.table(
        {
            "doc_id": pa.array([r[0] for r in rows], pa.int64()),
            "text": pa.array([r[1] for r in rows]),
            "bucket": pa.array([0] * len(rows), pa.int32()),
        }
    )


def test_a_prefix_is_as_long_as_its_frequency_asks():
    """`the same` begins many suffixes, `the same way` few: they go to different groups."""
    same = [f"the same way{i % 3} " + " ".join(f"w{i % 3}.{k}" for k in range(30)) for i in range(6)]
    docs = arrow(list(enumerate(same)))
    marks = repeats.repeated_anchors(repeats.part_anchors(docs, 1))
    lengths = []
    for level, depth in enumerate(repeats.PREFIXES):
        counts = repeats.part_prefixes(docs, marks, 1, level)
        marks = repeats.frequent_prefixes(counts, depth, 2)
        s = repeats.Suffixes(docs, marks)
        which = np.flatnonzero(~s.later)
        lengths.append(int(s.prefixes(which, repeats.PREFIXES[: level + 1])[1].sum()))
    # Three distinct suffixes share the first two words; with six words none does.
    assert lengths == [3, 0, 0]
    starts = np.flatnonzero(s.pos[which] == 0)
    assert len(set(s.prefixes(which)[0][starts].tolist())) == 3


def every_maximal(rows, size=20):
    """Maximal repeats by looking at every sequence of words."""
    texts = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    out, length = set(), size
    while True:
        places = {}
        for i, w in texts:
            for p in range(len(w) - length + 1):
                near = (w[p - 1] if p else None, w[p + length] if p + length < len(w) else None)
                places.setdefault(tuple(w[p : p + length]), []).append((i, p, *near))
        places = [v for v in places.values() if len(v) > 1]
        if not places:
            return out
        for v in places:
            lefts, rights = {x[2] for x in v}, {x[3] for x in v}
            if (len(lefts) > 1 or None in lefts) and (len(rights) > 1 or None in rights):
                out.add((*min(x[:2] for x in v), length, len(v)))
        length += 1


def check_maximal(corpus, rows, **kw):
    got = [tuple(r) for r in repeats.maximal_repeats(corpus(rows), **kw).collect()]
    assert len(got) == len(set(got))
    assert set(got) == every_maximal(rows)


def test_maximal_repeats(corpus):
    w = [f"w{i}" for i in range(120)]
    j = " ".join
    rows = [
        (1, j(w[:100])),
        (2, j(w[:100])),
        (3, j(["a"] + w[30:60] + ["b"])),
        (4, j(["c"] + w[30:60] + ["d"])),
        (5, j(w[25:55] + ["e"] + w[25:55])),
        (6, j(["same"] * 47)),
        (7, j(w[60:75] + ["same"] * 25)),
        (8, j((w[100:112]) * 5)),
        (9, j(w[:19])),
        (10, None),
    ]
    check_maximal(corpus, rows)
    check_maximal(corpus, rows[::-1], most=0)


def test_maximal_repeats_of_many_texts(corpus):
    check_maximal(corpus, some_rows(60))
    check_maximal(corpus, [(i % 7, t) for i, t in some_rows(25)], most=2)
    assert repeats.maximal_repeats(corpus([])).collect() == []


def test_every_place_of_a_repeat(corpus):
    """Repeats at the beginning, the end, over two documents, within one."""
    w = [f"w{i}" for i in range(100)]
    rows = [
        (1, " ".join(w[:50])),
        (2, " ".join(w[:20])),
        (3, " ".join(["x"] + w[30:50])),
        (4, " ".join(w[31:50] + ["y"])),
        (5, " ".join(w[60:85] + ["z"] + w[60:85])),
        (6, " ".join(["same"] * 45)),
        (7, " ".join(w[25:50] + w[:25])),
    ]
    check(corpus, rows)


def test_odd_rows(corpus, odd_rows):
    check(corpus, odd_rows, clashing=True)
    assert repeats.remove_repeats(corpus([])).collect() == []


def test_same_id_with_other_text(corpus):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(1, text), (1, "head " + text), (1, text), (2, text)]
    check(corpus, rows)
    check_maximal(corpus, rows)
