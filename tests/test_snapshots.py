"""The versioned store: idempotent merges, scoped deletes, refused versions."""

import tempfile

import pytest

from fathomline.sources.snapshots import SnapshotStore


@pytest.fixture()
def store(spark):
    s = SnapshotStore(spark, tempfile.mkdtemp(prefix="spark-"), ["k"], buckets=4)
    s.replace(spark.createDataFrame([(i, f"v{i}", None) for i in range(40)], "k int, v string, w string"))
    return s


def content(s):
    return {r.k: (r.v, r.w) for r in s.read().collect()}


def test_upsert_is_idempotent(spark, store):
    inc = spark.createDataFrame([(3, None, "new"), (99, "x", None)], "k int, v string, w string")
    store.upsert(inc)
    once = content(store)
    store.upsert(inc)
    assert content(store) == once and len(once) == 41
    assert once[3] == ("v3", "new") and once[99] == ("x", None) and once[4] == ("v4", None)


def test_untouched_buckets_keep_their_version(spark, store):
    before = store.manifest()
    store.upsert(spark.createDataFrame([(3, "z", None)], "k int, v string, w string"))
    after = store.manifest()
    assert sum(before[b] != after[b] for b in before) == 1


def test_delete(spark, store):
    store.delete(spark.createDataFrame([(1,), (2,), (500,)], "k int"), ["k"])
    assert set(content(store)) == set(range(40)) - {1, 2}


def test_repeated_keys_are_refused(spark, store):
    before = content(store)
    with pytest.raises(ValueError):
        store.replace(spark.createDataFrame([(1, "a", None), (1, "b", None)], "k int, v string, w string"))
    assert content(store) == before


def test_second_writer_of_a_version_fails(spark, store):
    with pytest.raises(Exception):
        store._commit(store._number() - 1, {})
