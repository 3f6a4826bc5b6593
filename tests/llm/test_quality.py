import random

import numpy as np

from boxframe.llm import quality
from boxframe.llm.tables import held_out_id

SYLLABLES = "an be co da er fo ga hi in jo ka lo ma no op pa qu re st ta".split()


def good(rng):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(150))


def bad(rng):
    return " ".join(
        "".join(rng.choices(SYLLABLES, k=2)).upper() + rng.choice(["!!", "###", "$$$"]) for _ in range(150)
    )


def tables(spark, corpus, n=400):
    rng = random.Random(5)
    docs = [(i, good(rng) if i % 3 else bad(rng)) for i in range(n)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(n)]
    return corpus(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_labels_are_predicted(spark, corpus):
    docs, labels = tables(spark, corpus)
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    held = [r for r in got if held_out_id(r.doc_id)]
    assert len(held) > 50
    assert np.mean([(r.score >= quality.LEAST) == (r.doc_id % 3 > 0) for r in held]) > 0.95


def test_labels_of_held_out_rows_do_not_matter(spark, corpus):
    docs, labels = tables(spark, corpus, 200)
    from pyspark.sql import functions as F

    from boxframe.llm.tables import held_out

    turned = labels.withColumn(
        "quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    one = sorted(map(tuple, quality.score(docs, quality.fit(docs, labels)).collect()))
    two = sorted(map(tuple, quality.score(docs, quality.fit(docs, turned)).collect()))
    assert one == two


def test_every_piece_of_a_long_text_counts():
    rng = random.Random(6)
    model = [b"".join(good(rng).encode() for _ in range(20)), b"".join(bad(rng).encode() for _ in range(20))]
    import pyarrow as pa

    sizes = quality.Sizes(model)
    start = good(rng) * 3
    values = sizes.values(pa.array([start, start + bad(rng) * 40, "", None]))
    assert values[0, 0] > 0 > values[1, 0]
    assert (values[2:] == 0).all()


def test_odd_rows_and_missing_labels(spark, corpus, odd_rows):
    docs, labels = tables(spark, corpus, 100)
    model = quality.fit(docs, labels.unionByName(spark.createDataFrame([(1, None, 0), (None, 1, 0), (0, 1, 1)], labels.schema)))
    got = quality.score(corpus(odd_rows, clashing=True), model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert got[0].score == got[7].score == got[8].score
    none = labels.where("false")
    assert quality.score(corpus(odd_rows), quality.fit(docs, none)).first().score == 0.5
    assert quality.score(corpus([]), model).collect() == []


def test_scores_equal_plain_sizes_and_sums(spark, corpus, odd_rows):
    import math

    import zstandard

    docs, labels = tables(spark, corpus, 120)
    model = quality.fit(docs, labels)
    rows = [r.asDict() for r in docs.collect()] + [r.asDict() for r in corpus(odd_rows).collect()]

    def size(data, dictionary):
        total = 0
        for at in range(0, len(data), quality.PIECE):
            # A new compressor for every piece, so nothing is carried over.
            more = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
            maker = zstandard.ZstdCompressor(
                level=quality.LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False, **more
            )
            total += len(maker.compress(data[at : at + quality.PIECE]))
        return total

    def plain(text):
        data = (text or "").encode()
        if data:
            good, bad, none = (size(data, d) for d in [*model["dictionaries"], None])
            ratios = [good / len(data), bad / len(data), none / len(data)]
            inputs = [1, 2 * (bad - good) / (bad + good), *ratios, *[math.log(max(r, 1e-3)) for r in ratios]]
        else:
            inputs = [1, 0, 0, 0, 0, 0, 0, 0]
        z = sum(a * b for a, b in zip(inputs, model["theta"], strict=True))
        return 1 / (1 + math.exp(-max(-30, min(30, z))))

    both = docs.unionByName(corpus(odd_rows))
    got = sorted((r.score for r in quality.score(both, model).collect()))
    assert np.allclose(got, sorted(plain(r["text"]) for r in rows), atol=1e-9)
