"""Tables that change together, merged file by file."""

import random

import pytest
from pyspark.sql import functions as F

from cairnflow.sources.snapshots import MOST_FILES, Snapshots, newest

SCHEMA = "k long, name string, v long"
KEY = ["k", "name"]


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def contents(store, version=None):
    return sorted((tuple(r) for r in store.read("t", SCHEMA, version).collect()), key=repr)


def test_merges_equal_plain_python_and_keep_files(spark, tmp_path):
    store, r, want = Snapshots(spark, str(tmp_path)), random.Random(3), {}
    for n in range(5):
        rows = [(r.choice([None, *range(300)]), r.choice(["a", "b", None]), n * 1000 + i) for i in range(400 if n == 0 else 6)]
        before = set(store.files("t"))
        store.commit({"t": store.merge("t", table(spark, rows), KEY, [F.col("_new"), F.col("v")], buckets=8)})
        for k, name, v in rows:
            want[k, name] = max(v, want.get((k, name), -1)) if v // 1000 == want.get((k, name), -1) // 1000 else v
        assert contents(store) == sorted(((k, name, v) for (k, name), v in want.items()), key=repr)
        if n:
            kept = before & set(store.files("t"))
            assert len(kept) >= len(before) - 6 and kept
    assert len(contents(store, 1)) < len(want)  # an older version still is what it was


def test_touched_files_are_those_that_may_hold_a_key(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    rows = table(spark, [(i, "a", i) for i in range(2000)])
    store.commit({"t": store.merge("t", rows, KEY, [F.col("v")])})
    files = store.files("t")
    for k in (0, 77, 1999):
        hit = store.touched("t", table(spark, [(k, "a", 0)]), KEY)
        assert any(store.read("t", SCHEMA, files=[f]).where(F.col("k") == k).count() for f in hit) and len(hit) < len(files)
    absent = [f for k in range(5000, 5020) for f in store.touched("t", table(spark, [(k, "a", 0)]), KEY)]
    assert len(absent) <= 2


def test_inserts_write_no_file_anew(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    store.commit({"t": store.insert("t", table(spark, [(1, "a", 1), (1, "a", 2), (2, None, 3)]), KEY, [-F.col("v")])})
    before = store.files("t")
    store.commit({"t": store.insert("t", table(spark, [(1, "a", 9), (2, None, 9), (3, "c", 9), (None, "c", 9)]), KEY, [F.col("v")])})
    assert set(before) <= set(store.files("t"))
    assert contents(store) == sorted([(1, "a", 1), (2, None, 3), (3, "c", 9), (None, "c", 9)], key=repr)
    store.commit({"t": store.insert("t", table(spark, []), KEY, [F.col("v")])})
    assert len(contents(store)) == 4


def test_crowded_buckets_become_one_file(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    for n in range(MOST_FILES + 2):
        store.commit({"t": store.merge("t", table(spark, [(n, "a", n)]), KEY, [F.col("v")], buckets=1)})
    assert len(store.files("t")) < MOST_FILES and len(contents(store)) == MOST_FILES + 2


def test_commits_are_whole_or_not_there(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    assert store.manifest()["version"] == 0 and store.read("t", SCHEMA).count() == 0
    left = store.append("t", table(spark, [(1, "lost", 1)]))  # never committed
    change = store.append("t", table(spark, [(1, "a", 1)]))
    assert store.commit({"t": change, "u": store.append("u", table(spark, [(2, "b", 2)]))}, {"batch": 7}) == 1
    assert contents(store) == [(1, "a", 1)] and store.manifest()["marks"] == {"batch": 7} and left.added
    assert store.vacuum() == len(left.added) and contents(store) == [(1, "a", 1)]
    with pytest.raises(RuntimeError):
        other = Snapshots(spark, str(tmp_path))
        other.manifest = lambda version=None: {"version": 0, "tables": {}, "index": {}, "marks": {}}
        other.commit({})


def test_newest_is_the_last_in_the_order(spark):
    rows = table(spark, [(1, "a", 3), (1, "a", 5), (None, "a", 1), (None, "a", None)])
    assert sorted(map(tuple, newest(rows, KEY, [F.col("v")]).collect()), key=repr) == sorted([(1, "a", 5), (None, "a", 1)], key=repr)
