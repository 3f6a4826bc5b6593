import math
import random

import pytest

from boxframe.llm import licences

PHRASES = [(licences._words(p), label) for p, label in licences.PHRASES]


def plain(rows, templates=licences.TEMPLATES, threshold=licences.THRESHOLD, phrases=PHRASES):
    """Per row the columns of `scanned`, by trying every place, block and template."""
    sets = [(label, licences._words(t)) for label, t in templates]
    out = []
    for r in rows:
        words = licences._words(r[1] or "")
        places = [(i, label) for i in range(len(words)) for p, label in phrases if words[i : i + len(p)] == p]
        found, most = set(), 0.0
        for label, t in sets:
            step, t = 1 << (len(t) - 1).bit_length() if t else 1, set(t)
            for b in range(0, len(words), step):
                n = len(t & set(words[b : b + 2 * step]))
                if t and n >= math.ceil(round(threshold * len(t), 9)):
                    found.add(label)
                    most = max(most, n / len(t))
        at = [i for i, _ in places]
        out.append(
            (
                r[0],
                len(words),
                len(places),
                min(at, default=None),
                max(at, default=None),
                sorted({label for _, label in places}),
                sorted(found),
                most,
            )
        )
    return sorted(out, key=repr)


def got(df, **kw):
    names = "doc_id n_words n_base first_word last_word base found containment".split()
    return sorted((tuple(r) for r in licences.scanned(df, **kw).select(*names).collect()), key=repr)


def altered(rng, text, drop=0, add=0):
    words = text.split()
    for _ in range(min(drop, len(words) - 1)):
        words.pop(rng.randrange(len(words)))
    for _ in range(add):
        words.insert(rng.randrange(len(words) + 1), rng.choice(["wibble", "the", "of", "foo"]))
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    common = "the of a to this license software you may copy work under files rights".split()
    filler = lambda n: " ".join(rng.choice(common + ["zeta", "éta", "Kappa"]) for _ in range(n))
    rows = []
    for _, t in licences.TEMPLATES:
        for drop in range(0, 7, 2):
            for add in (0, 3):
                rows.append(f"{filler(rng.randrange(90))}. {altered(rng, t, drop, add)}\n{filler(rng.randrange(90))}")
    rows += [filler(rng.randrange(400)) for _ in range(20)]
    rows += [
        "cc by cc by cc by",
        "CC-BY 4.0 and MIT-License, mit license",
        "gnu general public licenses; GNU General  Public\tLICENSE.",
        "cc bye acc by",
        "Apache License" * 3,
        "ça cc by é",
    ]
    return list(enumerate(rows))


def test_labels_match_trying_everything(corpus, texts, odd_rows):
    rows = texts + odd_rows
    want = plain(rows)
    assert sum(bool(r[6]) for r in want) > 30 and {label for r in want for label in r[6]} >= {"mpl", "bsd"}
    assert got(corpus(rows, clashing=True)) == want


def test_other_thresholds_batches_and_joins(corpus, texts, monkeypatch):
    monkeypatch.setattr(licences, "VOCABULARY", 30)
    monkeypatch.setattr(licences, "BROADCAST_ROWS", 0)
    assert got(corpus(texts), threshold=0.6) == plain(texts, threshold=0.6)


def test_without_templates_phrases_or_rows(corpus, odd_rows, texts):
    templates = [("none", " ... "), ("none", "")]
    assert got(corpus(odd_rows), templates=templates) == plain(odd_rows, templates)
    assert got(corpus(texts[:9]), phrases=()) == plain(texts[:9], phrases=[])
    assert got(corpus([])) == []


def test_overlapping_phrases(corpus):
    rows = [(1, "a b a b a b c"), (2, "b a b")]
    phrases = (("a b a", "x"), ("b c", "y"), ("b a b", "z"))
    want = plain(rows, phrases=[(p.split(), label) for p, label in phrases])
    assert got(corpus(rows), phrases=phrases) == want


def test_a_very_long_text(corpus):
    text = "free of the software permission to " * 40_000 + licences.TEMPLATES[-2][1] + " x" * 1000
    rows = [(1, text)]
    assert got(corpus(rows)) == plain(rows)
