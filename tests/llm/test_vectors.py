import numpy as np
import pytest

from boxframe.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """Links per row and smallest reachable id, by all cosines in double precision."""
    usable = {}
    for i, v, _ in rows:
        if i is not None and v and None not in v:
            x = np.array(v, np.float32).astype(np.float64)
            if np.isfinite(x).all() and x.any():
                x /= np.abs(x).max()
                usable[i] = x / np.linalg.norm(x)
    ids = sorted(usable)
    links, parent = dict.fromkeys((i for i, _, _ in rows), 0), {i: i for i, _, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if len(usable[i]) == len(usable[j]) and usable[i] @ usable[j] >= 0.9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return links, {i: find(i) for i in parent if i is not None}


def near(base, noise, rng):
    return (base + rng.normal(0, noise, len(base))).astype(np.float32).tolist()


def some_rows(rng, n=300, size=24):
    rows = []
    for g in range(12):
        base = rng.normal(0, 1, size)
        rows += [near(base, noise, rng) for noise in rng.uniform(0.05, 0.6, 4 + 3 * g)]
    rows += [rng.normal(0, 1, size).astype(np.float32).tolist() for _ in range(n)]
    rows += [rows[0]] * 9 + [[4 * x for x in rows[1]]]
    order = rng.permutation(len(rows))
    return [(int(i), rows[k], 0) for i, k in enumerate(order)]


def check(spark, rows):
    links, parts = brute(rows)
    got = vectors.near_vectors(spark.createDataFrame(rows, SCHEMA), lossless=True).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        else:
            assert (r.n_links, r.component_id) == (links[r.vec_id], parts[r.vec_id]), r
            assert r.kept == (r.vec_id == r.component_id)


def test_links_equal_all_cosines(spark):
    check(spark, some_rows(np.random.default_rng(1)))


def test_recall_in_many_dimensions():
    """Random vectors and links of a cosine of just 0.9: the hardest case."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(0, 1, x.shape)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = 0.9 * x + (1 - 0.81) ** 0.5 * y
    model = vectors.fit(x[:3000], 63)
    own, meets = vectors.probes(model, x, share=vectors.least_share(64))
    other, _ = vectors.probes(model, y)
    assert meets[np.arange(len(x)), other].mean() > 0.99
    assert meets.mean() < 0.5


def test_small_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(vectors, "INDEX_BLOCK", 16)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 16)
    check(spark, some_rows(np.random.default_rng(2), 100))


@pytest.mark.parametrize("cosine", [0.9, 0.7])
def test_probes_and_codes_lose_no_pair(cosine):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (1500, 16))
    x[::3] = x[::3] * 0.2 + rng.normal(0, 1, (5, 16))[rng.integers(0, 5, 500)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = vectors.fit(x[:500], 40)
    own, meets = vectors.probes(model, x, cosine)
    codes, missed = vectors.encode(model, x, own)
    exact = x @ x.T
    i, j = np.nonzero(exact >= cosine)
    assert meets[i, own[j]].all()
    rough = x @ model["centres"].T
    estimate = rough[i, own[j]] + sum(
        np.einsum("ij,ij->i", x[i, a:b], book[codes[j, m]])
        for m, (a, b, book) in enumerate(
            zip(model["cuts"][:-1], model["cuts"][1:], model["books"], strict=True)
        )
    )
    assert (estimate + missed[j] >= cosine - 1e-9).all()
    assert meets.mean() < 0.9


def test_odd_rows(spark):
    one = [1.0, 2.0, 3.0]
    rows = [
        (1, one, 0), (2, None, 0), (3, [], 0), (4, [0.0, 0.0, 0.0], 0), (5, [1.0, None, 3.0], 0),
        (6, [1.0, float("nan"), 3.0], 0), (7, [1.0, float("inf"), 3.0], 0), (8, one + [0.0], 0),
        (9, [1e38, 2e38, 3e38], 0), (10, [1e-38, 2e-38, 3e-38], 0), (None, one, 0), (11, [-1.0, -2.0, -3.0], 0),
        (12, [-0.0, 1.0, 0.0], None), (13, [0.0, 1.0, 0.0], None), (14, [5.0], 1), (15, [7.0], 1),
    ]
    check(spark, rows)
    twice = vectors.near_vectors(spark.createDataFrame([(1, one, 0), (1, one, 0), (2, one, 0)], SCHEMA))
    assert sorted(map(tuple, twice.collect())) == [(1, 1, 1, True)] * 2 + [(2, 1, 1, False)]
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def low_rank(rng, n, rank, size=64):
    x = rng.normal(0, 1, (n, rank)) @ rng.normal(0, 1, (rank, size))
    return [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)]


def counted(x, cosine=0.9):
    return (x @ x.T >= cosine).sum(1) - 1


def test_vectors_of_few_dimensions(spark):
    rows = low_rank(np.random.default_rng(5), 2500, 4)
    x = np.array([v for _, v, _ in rows], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = counted(x)
    df = spark.createDataFrame(rows, SCHEMA)
    found = lambda **kw: {r.vec_id: r.n_links for r in vectors.near_vectors(df, **kw).collect()}
    assert found(lossless=True) == dict(enumerate(want.tolist()))
    some = found()
    assert all(some[i] <= n for i, n in enumerate(want))
    assert sum(some.values()) >= 0.98 * want.sum()


@pytest.mark.parametrize("rank,n", [(3, 8000), (6, 16000), (64, 8000)])
def test_recall_of_the_measured_share(spark, rank, n):
    rng = np.random.default_rng(rank)
    x = rng.normal(0, 1, (n, rank)) @ rng.normal(0, 1, (rank, 64))
    x[: n // 10] = x[n // 2 : n // 2 + n // 10] + rng.normal(0, 0.4 * x.std(), (n // 10, 64)) * (rank == 64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    entries = spark.createDataFrame([(i, bytes(v.tobytes())) for i, v in enumerate(x)], "vec_id long, unit binary")
    entries = vectors.durable(entries)
    lists = round(n**0.5)
    model = vectors.fit(vectors._sampled(entries, n, lists), lists)
    share = vectors.measured_share(entries, model)
    own, meets = vectors.probes(model, x, share=share)
    met = all_links = 0
    for low in range(0, n, 2000):
        i, j = np.nonzero(x[low : low + 2000] @ x.T >= 0.9)
        i += low
        i, j = i[own[i] <= own[j]], j[own[i] <= own[j]]
        all_links += len(i)
        met += meets[i, own[j]].sum()
    assert all_links > 1000 and met >= 0.98 * all_links
    if rank == 64:
        assert meets.mean() < 0.5


def test_samples_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(8)
    rows = [(i, bytes(rng.normal(0, 1, 4).tobytes())) for i in range(9000)]
    df = spark.createDataFrame(rows, "vec_id long, unit binary")
    a = vectors._sampled(df.repartition(3), 9000, 10)
    assert len(a) == 8192 and (a == vectors._sampled(df.repartition(7, "unit"), 9000, 10)).all()


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = some_rows(np.random.default_rng(9), 40)
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, vectors.near_vectors(df).collect()))
    names = ("key", "unit", "size", "weight", "list", "own", "i", "q", "links", "kept", "comp", "h")
    df = df.withColumns({c: F.lit("own") for c in names})
    assert sorted(map(tuple, vectors.near_vectors(df).collect())) == want
