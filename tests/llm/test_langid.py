import random

import numpy as np
import pyarrow as pa

from boxframe.llm import langid, tables

WORDS = {
    "en": "the and of house water there with which thing night under".split(),
    "de": "der und das haus wasser schön nicht über straße zwischen".split(),
    "fr": "le la les maison eau où être français garçon après très".split(),
}


def text(lang, n, rng):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def rows(n):
    rng = random.Random(1)
    langs = sorted(WORDS)
    return [(i, text(langs[i % 3], 5 + i % 90, rng), langs[i % 3]) for i in range(n)]


def test_held_out_texts_are_recognised(corpus):
    docs = corpus(rows(600))
    found = langid.identify(docs, langid.fit(langid.sample(docs)), ["doc_id", "lang"]).collect()
    assert len(found) == 600
    from boxframe.llm.tables import held_out_id

    held = [r for r in found if held_out_id(r.doc_id)]
    assert 100 < len(held) < 200
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_folded_tables_equal_plain_convolution():
    model = langid.fit([(t, lang) for _, t, lang in rows(150)])
    net = langid.Identifier(model)
    codes = np.random.default_rng(2).integers(0, 155, 5 * 256 + 4, dtype=np.uint8)
    x = np.stack([codes[i * 256 : i * 256 + 259] for i in range(5)])
    pooled, _ = langid._forward(model["net"], x)
    hidden = np.maximum(pooled + model["net"]["bias"], 0)
    want = hidden @ model["net"]["dense"] + model["net"]["shift"]
    assert np.allclose(net.windows(codes), want, atol=1e-3)


def test_gradients_follow_differences():
    rng = np.random.Generator(np.random.PCG64(3))
    net = {k: v.astype(np.float64) for k, v in langid._start(3, rng).items()}
    x = rng.integers(0, 155, (6, 259)).astype(np.uint8)
    y = np.array([0, 1, 2, 0, 1, 2])
    g, _ = langid._gradients(net, x, y)

    def loss():
        pooled, _ = langid._forward(net, x)
        p = langid._softmax(np.maximum(pooled + net["bias"], 0) @ net["dense"] + net["shift"])
        return -np.log(p[np.arange(6), y]).mean()

    for name, at in (("dense", (3, 1)), ("shift", (2,)), ("bias", (5,)), ("filter3", (1, 2, 4))):
        before = net[name][at]
        net[name][at] = before + 1e-5
        up = loss()
        net[name][at] = before - 1e-5
        down = loss()
        net[name][at] = before
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-4


def test_whole_text_counts_not_its_beginning(corpus):
    rng = random.Random(4)
    model = langid.fit([(t, lang) for _, t, lang in rows(300)])
    late = text("en", 30, rng) + " " + text("de", 3000, rng)
    got = langid.identify(corpus([(1, late)]), model).first()
    assert got.lang_pred == "de"


def test_odd_rows(corpus, odd_rows):
    docs = corpus(odd_rows, clashing=True)
    model = langid.fit(langid.sample(docs))
    got = langid.identify(docs, model).collect()
    assert len(got) == len(odd_rows)
    for r, row in zip(got, odd_rows, strict=True):
        unknown = not any(c.isalpha() for c in row[1] or "")
        assert (r.lang_pred == "und") == unknown and (r.score == 0.0) == unknown
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns
    assert sum(r.text is None for r in kept.collect()) == 0
    assert langid.accepted(corpus([])).collect() == []
    blank = langid.identify(corpus([(1, "abc")]), langid.fit(langid.sample(corpus([(1, "abc")]))))
    assert [tuple(r) for r in blank.collect()] == [(1, "und", 0.0)]


def test_more_languages_than_the_sample_has_room_for(corpus, monkeypatch):
    rows = [(i, f"text {i}", f"l{i % 30:02}", "a", 1) for i in range(1200)]
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    some = langid.sample(corpus(rows), 20)
    names = [lang for _, lang in some]
    assert set(names) == {f"l{i:02}" for i in range(30)} and max(map(names.count, names)) == 2
    assert some == langid.sample(corpus(rows).repartition(5, "text"), 20)
    assert 0 < len({lang for _, lang in langid.sample(corpus(rows), 4)}) <= 16


def test_small_batches_are_joined_to_the_parts_of_large_ones():
    rng = random.Random(9)
    texts = [rng.choice([None, "", "x" * rng.randrange(40)]) for _ in range(500)]
    whole = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    for rows, most in ((500, 60), (70, 300), (0, 10), (7, 10**6)):
        large = [whole.slice(i, rows or 500) for i in range(0, 500, rows or 500)]
        want = [p.to_pylist() for b in large for p in tables.slices(b, "text", most)]
        small = [b.slice(i, 11) for b in large for i in range(0, b.num_rows, 11)]
        assert [p.to_pylist() for p in tables.joined(small, "text", rows, most)] == want
    assert list(tables.joined([], "text", 10)) == []
