import os

import pytest
from conftest import rows

from boxframe.sources import files, listing


@pytest.fixture()
def tree(tmp_path):
    sizes = {}
    for i in range(60):
        folder = ["labels/train", "labels/val", "labels/val/deep/er", "other"][i % 4]
        path = tmp_path / folder / f"f {i}.{'txt' if i % 5 else 'bin'}"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x\n" * (i * 7))
        sizes[str(path)] = i * 14
    (tmp_path / "labels" / "none").mkdir()
    return str(tmp_path), sizes


def test_walks_all_folders(spark, tree):
    root, sizes = tree
    got = listing.list_files(spark, [root])
    assert {r.path: r.length for r in got.collect()} == sizes
    at = {r.path: r.modified.timestamp() for r in got.collect()}
    assert all(abs(at[p] - os.stat(p).st_mtime) < 0.01 for p in sizes)
    some = listing.list_files(spark, [f"{root}/labels", f"{root}/labels", f"{root}/missing"], ".txt")
    assert {r.path for r in some.collect()} == {p for p in sizes if "/labels/" in p and p.endswith(".txt")}
    one = next(iter(sizes))
    assert [r.path for r in listing.list_files(spark, [one]).collect()] == [one]
    assert listing.list_files(spark, []).count() == 0


def test_packs_are_runs_of_bytes(spark, tree, monkeypatch):
    monkeypatch.setattr(listing, "OPENING", 1)
    root, sizes = tree
    listed = listing.list_files(spark, [root])
    got = {r.path: r.pack for r in listing.packed(listed, 500).collect()}
    at = 0
    for path in sorted(sizes):
        assert got[path] == at // 500
        at += sizes[path] + 1
    whole = {r.path: len(r.content) for r in listing.read_packed(listed, 500).collect()}
    assert whole == sizes
    os.remove(sorted(sizes)[3])
    gone = [r.path for r in listing.read_packed(listed, 500).collect() if r.content is None]
    assert gone == [sorted(sizes)[3]]
    assert listing.read_packed(listed.where("false")).collect() == []
    with pytest.raises(ValueError):
        listing.packed(listed, 0)


def test_label_lines_as_from_whole_files(spark, tmp_path):
    for split in ("train", "val"):
        (tmp_path / "labels" / split).mkdir(parents=True)
    texts = [b"", b"0 1 1 1 1", b"a\r\nb\rc\n", b"\xff\n\n", "ü\n".encode()]
    for i, text in enumerate(texts):
        (tmp_path / "labels" / ("train" if i % 2 else "val") / f"s {i}.txt").write_bytes(text)
    want = files.read_label_lines(spark, str(tmp_path))
    for size in (1, 100_000):
        assert rows(listing.read_label_lines(spark, str(tmp_path), size)) == rows(want)


def test_very_many_packs_do_not_make_as_many_tasks(spark, tmp_path, monkeypatch):
    from boxframe.sources import listing as module

    for i in range(40):
        (tmp_path / f"{i}.txt").write_text(str(i))
    monkeypatch.setattr(module, "TASKS", 1)
    read = module.read_packed(module.list_files(spark, [str(tmp_path)], ".txt"), 1)
    assert read.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert sorted(int(r.content) for r in read.collect()) == list(range(40))
