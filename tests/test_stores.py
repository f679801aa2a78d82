"""Stores: versions by parts, writes and moves that break off, deletes."""

from __future__ import annotations

import pytest

from entrack.sources import files as S
from pyspark.sql import functions as F


@pytest.fixture
def make(spark, tmp_path):
    return lambda name: S.Store(spark, f"file://{tmp_path}/{name}")


def ids(store: S.Store) -> list:
    return sorted(r.id for r in store.read().collect())


def test_the_tenth_version_is_newer_than_the_ninth(spark, make):
    store = make("a")
    assert store.version() is None and store.seed(spark.range(3), "v9") and not store.seed(spark.range(4), "v10")
    assert store.replace(spark.range(5), "v10") and not store.replace(spark.range(6), "v9") and not store.replace(spark.range(6), "v10")
    assert ids(store) == [0, 1, 2, 3, 4] and store.version() == "v10"
    order = ["1", "1.2", "1.10", "2.0.0", "10"]
    assert sorted(reversed(order), key=S.version_parts) == order


def test_a_write_that_breaks_off_leaves_the_old_version(spark, make):
    store = make("b")
    store.seed(spark.range(3), "v1")
    reader = store.read()
    store.write(spark.range(9))
    assert ids(make("b")) == [0, 1, 2] and store.version() == "v1"

    def broken(batches):
        raise ValueError("no rows")
        yield from batches

    with pytest.raises(Exception, match="no rows"):
        store.replace(spark.range(4).mapInPandas(broken, "id long"), "v2")
    assert store.version() == "v1" and ids(store) == [0, 1, 2]
    assert store.replace(spark.range(4), "v2") and ids(store) == [0, 1, 2, 3]
    assert reader.count() == 3  # those who read the version before are not disturbed


def test_two_commits_at_once(spark, make):
    first, second = make("c"), make("c")
    folders = [s.write(spark.range(n)) for s, n in ((first, 2), (second, 5))]
    numbers = second._pointers()
    assert first.commit("v1", folders[0])
    second._pointers = lambda: numbers  # what it saw before
    assert not second.commit("v1", folders[1])
    assert ids(make("c")) == [0, 1]


def test_deletes_by_prefix_and_by_null(spark, make):
    store = make("d")
    store.seed(spark.createDataFrame([(1, "ab"), (2, "abc"), (3, "ac"), (4, None)], "id long, key string"), "1")
    store.delete_prefix("key", "ab")
    assert ids(store) == [3, 4]


def test_a_migration_that_breaks_off_is_made_good(spark, make):
    old, new = make("old"), make("new")
    old.seed(spark.range(10), "1")
    real, old.delete = old.delete, lambda gone: (_ for _ in ()).throw(RuntimeError("stopped"))
    with pytest.raises(RuntimeError):
        S.migrate(old, new, "id", F.col("id") < 4)
    assert ids(old) == list(range(10)) and ids(new) == [0, 1, 2, 3]
    old.delete = real
    S.migrate(old, new, "id", F.col("id") < 4)
    S.migrate(old, new, "id", F.col("id") > 7)
    assert ids(old) == [4, 5, 6, 7] and ids(new) == [0, 1, 2, 3, 8, 9]
