"""Versioned tables: replays, writers that die, writers that meet, partitions left alone."""

import pytest
from pyspark.sql import functions as F

from basketlens.sinks.versioned import ConcurrentCommit, VersionedTable


def rows(spark, data):
    return spark.createDataFrame(data, "chain_id string, code string, price double, ord int")


@pytest.fixture
def made(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "prices"), ["chain_id", "code"], ["chain_id"], buckets=2)


FIRST = [("1", "a", 1.0, 0), ("1", "a", 2.0, 1), ("1", "b", 3.0, 0), ("2", "a", 4.0, 0), ("x/y=z é", "a", 5.0, 0), (None, "n", 6.0, 0)]


def content(table, version=None):
    return sorted((str(r["chain_id"]), r["code"], r["price"]) for r in table.read(version).collect())


def test_upsert_and_replay(spark, made):
    assert not made.exists()
    assert made.upsert(rows(spark, FIRST), ["ord"]) == 1
    want = [("1", "a", 2.0), ("1", "b", 3.0), ("2", "a", 4.0), ("None", "n", 6.0), ("x/y=z é", "a", 5.0)]
    assert content(made) == sorted(want)
    made.upsert(rows(spark, [("1", "a", 9.0, 0), ("3", "c", 7.0, 0)]), ["ord"], ("feed", 1))
    after = content(made)
    assert ("1", "a", 9.0) in after and ("1", "b", 3.0) in after and len(after) == 6
    made.upsert(rows(spark, [("1", "a", 9.0, 0), ("3", "c", 7.0, 0)]), ["ord"])  # the same feed again
    assert content(made) == after
    n = len(made.versions())
    made.upsert(rows(spark, [("1", "a", 99.0, 0)]), ["ord"], ("feed", 1))  # a batch that was taken in
    assert content(made) == after and len(made.versions()) == n
    assert content(made, 1) == sorted(want)


def test_only_touched_partitions_are_written(spark, made):
    made.upsert(rows(spark, FIRST), ["ord"])
    before = made.manifest()["partitions"]
    made.upsert(rows(spark, [("2", "a", 8.0, 0)]), ["ord"])
    now = made.manifest()["partitions"]
    assert now.keys() == before.keys() and sum(now[k] != before[k] for k in now) == 1
    assert made.vacuum(keep=1) == 1 and len(made.versions()) == 1
    assert ("2", "a", 8.0) in content(made) and len(content(made)) == 5


def test_a_writer_that_dies_leaves_the_old_table(spark, made, monkeypatch):
    made.upsert(rows(spark, FIRST), ["ord"])
    before = content(made)
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_publish", lambda self, manifest: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            made.upsert(rows(spark, [("1", "a", 0.0, 0)]), ["ord"])
    assert content(made) == before
    made.upsert(rows(spark, [("1", "a", 0.5, 0)]), ["ord"])
    assert ("1", "a", 0.5) in content(made)
    with pytest.raises(Exception, match="lost"):  # a task that fails
        made.upsert(rows(spark, [("1", "a", 7.0, 0)]).withColumn("price", F.raise_error(F.lit("lost")).cast("double")), ["ord"])
    assert ("1", "a", 0.5) in content(made)


def test_of_two_writers_one_starts_again(spark, made, monkeypatch):
    made.upsert(rows(spark, FIRST), ["ord"])
    publish = VersionedTable._publish

    def late(self, manifest):
        monkeypatch.setattr(VersionedTable, "_publish", publish)
        made.upsert(rows(spark, [("2", "a", 1.5, 0)]), ["ord"])  # the other one is faster
        publish(self, manifest)

    monkeypatch.setattr(VersionedTable, "_publish", late)
    with pytest.raises(ConcurrentCommit):
        made.upsert(rows(spark, [("1", "a", 1.5, 0)]), ["ord"])
    assert ("2", "a", 1.5) in content(made) and ("1", "a", 2.0) in content(made)


def test_coalesce_insert_delete(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "products"), ["barcode"])
    frame = lambda data: spark.createDataFrame(data, "barcode string, name string, maker string")
    table.upsert_coalesce(frame([("1", "a", "m"), ("2", "b", None)]), ["maker"])
    table.upsert_coalesce(frame([("1", "aa", None), ("3", None, None)]), ["maker"])
    got = lambda: sorted(tuple(r) for r in table.read().collect())
    assert got() == [("1", "aa", "m"), ("2", "b", None), ("3", None, None)]
    table.insert_ignore(frame([("1", "z", "z"), ("4", "d", "d"), ("4", "d", "d")]))
    assert len(got()) == 4 and got()[0] == ("1", "aa", "m")
    table.delete(spark.createDataFrame([("1",), ("9",)], "barcode string"))
    assert [r[0] for r in got()] == ["2", "3", "4"]
    table.delete(table.read().select("barcode"))
    assert got() == []
    table.upsert(frame([("5", "e", "e")]).withColumn("ord", F.lit(1)), ["ord"])
    assert got() == [("5", "e", "e")]
