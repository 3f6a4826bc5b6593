import random

import corpus_pipeline
from boxframe.llm import langid, mixing, pii, registered
from boxframe.operators.groups import durable

from .test_near import components
from .test_templates import ITEM


def write(spark, folder, rows, items):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{folder}/documents.parquet"
    )
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_run_equals_plain_steps(spark, tmp_path, odd_rows):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices(["the", "an", "ed", "in", "st", "or", "wa"], k=rng.randint(1, 3)))
    rows = [(100 + i, " ".join(word() for _ in range(60)), "en", f"s{i % 4}", 0) for i in range(80)]
    rows += [(300 + i, rows[i][1] + " end", "en", "s1", 0) for i in range(20)]
    rows += [(400 + i, f"{rows[40 + i][1]} {ITEM} {word()}", "en", "s2", 0) for i in range(5)]
    rows += odd_rows
    write(spark, str(tmp_path), rows, [(1, ITEM), (2, None)])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    found = langid.identify(docs, langid.fit(langid.sample(docs)), docs.columns).collect()
    kept = [tuple(r)[:5] for r in found if r.lang_pred != "und" and r.score >= 0.4]
    parts, _ = components(kept)
    kept = [r for r in kept if r[0] is None or parts[r[0]] == r[0]]
    assert any(ITEM in r[1] for r in kept)
    kept = [r for r in kept if ITEM not in r[1]]
    frame = durable(spark.createDataFrame(kept, docs.schema))
    clean = durable(pii.masked(frame))
    assert not [r for r in clean.collect() if pii.base_spans(r.text)]
    copies = {}
    for r in mixing.mix(clean).collect():
        copies.setdefault(r.doc_id, []).append(r.copies)
    want = sorted(i or -1 for i, n in copies.items() for m in n for _ in range(m))
    assert sorted(r.doc_id or -1 for r in got) == want


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path, corpus, odd_rows):
    write(spark, str(tmp_path), odd_rows, [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus(odd_rows, clashing=True)
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, corpus([]), str(tmp_path)).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, corpus([]), str(tmp_path)).collect() == []


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registered.QUERIES)
    assert numbers == list(range(1, 14))


def test_near_duplicates_of_80_percent_go(spark, corpus):
    words = [f"b{i}" for i in range(154)]
    # Three words apart change 15 of 150 shingles: 135 of 165 are shared, 0.82.
    near = [f"w{i}" if i in (30, 70, 110) else w for i, w in enumerate(words)]
    # Four change 20: 130 of 170, 0.76.
    far = [f"v{i}" if i in (20, 50, 90, 130) else w for i, w in enumerate(words)]
    docs = corpus([(i, " ".join(t)) for i, t in enumerate((words, near, far))])
    kept = corpus_pipeline.deduplicated(spark, docs, None).collect()
    assert sorted(r.doc_id for r in kept) == [0, 2]
