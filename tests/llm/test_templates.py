import random

import pytest

from boxframe.llm import templates

ITEM = (
    "A train leaves the station at 40 km per hour and Tom Miller walks 3 km to meet it before "
    "the bell rings twice, then Tom Miller waits 3 hours for the next one to come along the line."
)


def filler(rng, n=60):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, ITEM), (2, "too short to tell"), (3, None), (None, None), (1, ITEM)]
    return spark.createDataFrame(rows, "item_id long, text string")


def found(corpus, items, rows, **kw):
    return {(r.doc_id, r.item_id) for r in templates.leaks(corpus(rows, **kw), items).collect()}


def test_verbatim_reparameterised_and_inconsistent(corpus, items):
    rng = random.Random(3)
    wrap = lambda t: f"{filler(rng)}. {t} {filler(rng)}"
    other = ITEM.replace("40", "75").replace("3", "12").replace("Tom Miller", "Ada").replace("hours", "days")
    broken = other.replace("Ada waits", "Bob waits")
    merged = other.replace("75", "12")
    rows = [
        (10, wrap(ITEM)),
        (11, wrap(ITEM.upper().lower())),
        (12, wrap(other)),
        (13, wrap(broken)),
        (14, wrap(merged)),
        (15, filler(rng, 300)),
        (16, wrap(ITEM) + wrap(other)),
        (17, wrap(" ".join(ITEM.split()[:9]))),
        (18, wrap(" ".join(ITEM.split()[14:34]))),
    ]
    hits = found(corpus, items, rows)
    assert {(10, 1), (12, 1), (16, 1), (18, 1)} <= hits
    assert not hits & {(13, 1), (14, 1), (15, 1), (17, 1)}


def test_shuffled_windows_give_the_same(corpus, items, monkeypatch):
    rng = random.Random(4)
    rows = [(i, filler(rng) + " " + (ITEM if i % 3 == 0 else "") + filler(rng)) for i in range(30)]
    want = found(corpus, items, rows)
    assert len(want) == 10
    monkeypatch.setattr(templates, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(templates, "BROADCAST_ROWS", 0)
    assert found(corpus, items, rows) == want
    kept = templates.without_leaks(corpus(rows), items).collect()
    assert {r.doc_id for r in kept} == {i for i in range(30) if i % 3}


def test_odd_rows(corpus, items, odd_rows, spark):
    docs = corpus(odd_rows + [(20, ITEM), (None, ITEM)], clashing=True)
    assert {(r.doc_id, r.item_id) for r in templates.leaks(docs, items).collect()} == {(20, 1), (None, 1)}
    kept = templates.without_leaks(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(odd_rows)
    none = spark.createDataFrame([], items.schema)
    assert templates.without_leaks(docs, none).count() == len(odd_rows) + 2
    assert templates.leaks(corpus([]), items).collect() == []


def test_items_full_of_slots(corpus, spark):
    rng = random.Random(5)
    mean = "Find the mean of 4, 8, 15, 16, 23 and 42"
    add = "Add 3 and 5 and 7 and 9 and 11 and 13"
    bare = "17 4 99 23 8 61 5 70 31 2"
    mixed = "The boxes hold 4 kg, 8 kg, 15 kg, 16 kg, 23 kg and 42 kg of flour"
    rows = list(enumerate((mean, add, bare, mixed), 1))
    items = spark.createDataFrame(rows, "item_id long, text string")
    wrap = lambda t: f"{filler(rng)}. {t} {filler(rng)}"
    other = mean.replace("15", "77").replace("42", "90")
    docs = [(10 * i, wrap(t)) for i, t in rows]
    docs += [(11, wrap(other)), (12, wrap(other.replace("8", "4"))), (31, wrap(bare.replace("61", "62")))]
    docs += [(50, " ".join(str(rng.randrange(10**6)) for _ in range(200))), (60, filler(rng, 200))]
    assert found(corpus, items, docs) == {(10, 1), (20, 2), (30, 3), (40, 4), (11, 1)}
    kept = templates.without_leaks(corpus(docs), items).collect()
    assert {r.doc_id for r in kept} == {12, 31, 50, 60}


def sql_leaks(docs, items):
    """The registered SQL over small tables."""
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    documents = pd.DataFrame([r[:2] for r in docs], columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    benchmark = pd.DataFrame(items, columns=["item_id", "text"]).astype({"item_id": "Int64"})
    con.register("documents", documents)
    con.register("benchmark", benchmark)
    return sorted(con.execute(templates.SQL).fetchall(), key=repr)


def test_sql_has_the_same_rule(corpus, odd_rows, spark):
    rng = random.Random(8)
    texts = [
        "Find the mean of 4, 8, 15, 16, 23 and 42",
        "17 4 99 23 8 61 5 70 31 2 17 4",
        "The boxes hold 4 kg, 8 kg, 15 kg, 16 kg, 23 kg and 42 kg of flour",
        ITEM,
        " ".join(str(rng.randrange(30)) for _ in range(40)),
    ]
    items = list(enumerate(texts)) + [(None, texts[0]), (9, None), (9, "a b c")]
    docs = [r for r in odd_rows if len(r[1] or "") < 10_000]
    for i in range(150):
        words = rng.choice(texts).split()
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(words))
            words[at] = rng.choice(["7", "kg", "Ada", "word", words[rng.randrange(len(words))]])
        docs.append((100 + i, f"{filler(rng, 20)} {' '.join(words)} {filler(rng, 20)}"))
    docs.append((None, " ".join(texts)))
    want = sql_leaks(docs, items)
    assert len(want) > 60
    got = templates.leaks(corpus(docs, clashing=True), spark.createDataFrame(items, "item_id long, text string"))
    columns = ["doc_id", "item_id", "covered", "item_tokens", "n_slots"]
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == want


def test_very_long_runs_of_names_and_numbers(corpus, items):
    rows = [
        (1, "the " + "Anna Berta " * 90_000 + ITEM),
        (2, "1." * 500_000 + "1 x. " + ITEM),
        (3, "1.1,1 " * 100_000 + "one two " * 100_000),
    ]
    assert found(corpus, items, rows) == {(1, 1), (2, 1)}


def test_one_altered_word_is_found(corpus, spark):
    words = filler(random.Random(6), 20).split()
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    rows = [(i, " ".join(words[:i] + ["zzz"] + words[i + 1 :])) for i in range(20)]
    want = {(i, 1) for i in range(20) if sum(max(0, n if n >= 8 else 0) for n in (i, 19 - i)) >= 13}
    assert len(want) >= 10 and found(corpus, items, rows) == want


def test_tables_of_numbers_do_not_meet_on_all_places(corpus, spark):
    rng = random.Random(7)
    numbers = [str(rng.randrange(10**6)) for _ in range(4000)]
    item = " ".join(numbers[1000:1040])
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = corpus([(1, " ".join(numbers)), (2, " ".join(reversed(numbers)))])
    bench = templates.durable(templates.benchmark_windows(items))
    windows = templates._found_windows(docs, bench)
    assert windows.count() == 2 * (4000 - 7)
    assert templates._aligned_windows(windows, bench).distinct().count() == 33
    assert found(corpus, items, [(1, " ".join(numbers)), (2, " ".join(reversed(numbers)))]) == {(1, 1)}
