"""Keyed tables on disk: replays, untouched buckets, and batches that were cut off."""

import os

import pytest
from pyspark.sql import functions as F

from loomlake import sinks
from loomlake.sinks import KeyedTable, newest, newest_set, summed


def files(path):
    """Every data file of a table with its size and when it was written."""
    return {os.path.join(d, f): (os.stat(os.path.join(d, f)).st_size, os.stat(os.path.join(d, f)).st_mtime_ns) for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def bucket_of(path):
    return path.split("_bucket=")[1].split("/")[0]


@pytest.fixture
def table(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "k long, v string, version long", ["k"], 8)
    assert t.insert(0, spark.range(100).selectExpr("id as k", "'old' as v", "0L as version"))
    return t


def changes(spark, rows):
    return spark.createDataFrame(rows, "k long, v string, version long")


def test_replay_changes_nothing_on_disk(spark, table):
    batch = changes(spark, [(3, "new", 2), (3, "older", 1), (200, "more", 1)])
    assert table.upsert(1, batch, newest(["k"], ["version"]))
    before, rows = files(table.path), sorted(map(tuple, table.rows().collect()))
    assert not table.upsert(1, batch, newest(["k"], ["version"])) and not table.upsert(0, batch, newest(["k"], ["version"]))
    again = KeyedTable(spark, table.path, table.schema, ["k"], 8)  # as after a restart
    assert not again.upsert(1, batch, newest(["k"], ["version"]))
    assert files(table.path) == before and sorted(map(tuple, again.rows().collect())) == rows
    assert len(rows) == 101 and (3, "new", 2) in rows and (200, "more", 1) in rows and again.applied() == 1


def test_other_buckets_keep_their_files(spark, table):
    before = files(table.path)
    touched = str(table.rows().where("k = 3").select(F.pmod(F.xxhash64("k"), F.lit(8))).first()[0])
    table.upsert(1, changes(spark, [(3, "new", 1)]), newest(["k"], ["version"]))
    after = files(table.path)
    assert {f for f in before if bucket_of(f) != touched} == {f for f in after if bucket_of(f) != touched}
    assert all(before[f] == after[f] for f in before if bucket_of(f) != touched)
    assert not {f for f in before if bucket_of(f) == touched} & set(after)


def test_insert_adds_files_and_rewrites_none(spark, table):
    before = files(table.path)
    assert table.insert(1, changes(spark, [(3, "again", 9), (101, "a", 1), (101, "a", 1)]))
    after = files(table.path)
    assert all(after[f] == before[f] for f in before) and table.rows().count() == 101 and table.rows().where("v = 'again'").isEmpty()


@pytest.mark.parametrize("cut", range(1, 8))
def test_batches_that_are_cut_off(spark, table, monkeypatch, cut):
    """Stopped at any file operation, a batch is whole or has no effect, and sent again it is whole."""
    gone = lambda old, new: old.join(new, "k", "left_anti")
    batch = changes(spark, [(k, None, 1) for k in range(0, 100) if k % 3])
    want = sorted(map(tuple, table.rows().where("k % 3 = 0").collect()))
    calls = 0

    def breaks(f):
        def run(*args):
            nonlocal calls
            calls += 1
            if calls == cut:
                raise OSError("cut off")
            return f(*args)

        return run

    for name in ("move", "discard", "make_folder"):
        monkeypatch.setattr(sinks, name, breaks(getattr(sinks, name)))
    with pytest.raises(OSError):
        table.upsert(1, batch, gone)
    again = KeyedTable(spark, table.path, table.schema, ["k"], 8)
    again.upsert(1, batch, gone)
    assert sorted(map(tuple, again.rows().collect())) == want and again.applied() == 1


def test_buckets_that_become_empty(spark, table):
    table.upsert(1, table.rows(), lambda old, new: old.limit(0))
    assert table.rows().isEmpty() and not files(table.path)
    assert table.upsert(2, changes(spark, []), newest(["k"], ["version"])) and table.rows().isEmpty()
    assert table.insert(3, changes(spark, [(1, "back", 1)])) and table.rows().count() == 1


def test_sources_have_ledgers_of_their_own(spark, table):
    assert table.upsert(1, changes(spark, [(1, "a", 1)]), newest(["k"], ["version"]), "one")
    assert table.upsert(1, changes(spark, [(1, "b", 2)]), newest(["k"], ["version"]), "two")
    assert table.rows().where("k = 1").first().v == "b" and (table.applied("one"), table.applied("two")) == (1, 1)


def test_merges(spark, tmp_path):
    sets = KeyedTable(spark, str(tmp_path / "s"), "k long, part int, at long", ["k"], 4)
    put = lambda n, rows: sets.upsert(n, spark.createDataFrame(rows, "k long, part int, at long"), newest_set(["k"], "at"))
    put(0, [(1, 0, 5), (1, 1, 5), (2, 0, 5)])
    put(1, [(1, 0, 7), (2, 0, 3), (2, 1, 3), (3, 0, 1)])
    put(2, [(1, 7, 7)])
    assert sorted(map(tuple, sets.rows().collect())) == [(1, 7, 7), (2, 0, 5), (3, 0, 1)]
    sums = KeyedTable(spark, str(tmp_path / "n"), "k long, n long", ["k"], 4)
    for batch in (0, 1, 1):
        sums.upsert(batch, spark.createDataFrame([(1, 2), (1, 3), (2, 1)], "k long, n long"), summed(["k"], {"n": "sum"}))
    assert sorted(map(tuple, sums.rows().collect())) == [(1, 10), (2, 2)]
