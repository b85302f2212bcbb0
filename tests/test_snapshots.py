"""Versioned tables: failed writes, pinned readers, replays, deltas, conflicts."""

import pytest
from conftest import frame
from pyspark.sql import functions as F

from tidegauge.sources.snapshots import CommitConflict, SnapshotTable


DDL = "k string, v int, seq int"


def rows(table, version=None):
    return sorted(tuple(r) for r in table.read(version).collect())


@pytest.fixture()
def table(spark, tmp_path):
    return SnapshotTable(spark, str(tmp_path / "t"), ["k"], "seq")


def test_a_write_that_fails_half_way_leaves_the_old_rows(spark, table):
    table.replace(frame(spark, DDL, [("a", 1, 1), ("b", 2, 1)]))
    broken = spark.range(8, numPartitions=4).select(F.lit("c").alias("k"), F.when(F.col("id") == 7, F.raise_error(F.lit("torn"))).otherwise(F.lit(1)).cast("int").alias("v"), F.lit(1).alias("seq"))
    for write in (table.replace, table.upsert, table.append, lambda df: table.replace_where(df, ["k"])):
        with pytest.raises(Exception, match="torn"):
            write(broken)
    assert rows(table) == [("a", 1, 1), ("b", 2, 1)] and table.versions() == [1]


def test_a_reader_ends_with_the_version_it_began_with(spark, table):
    table.replace(frame(spark, DDL, [("a", 1, 1)]))
    began = table.read()
    table.replace(frame(spark, DDL, [("a", 9, 1)]))
    table.upsert(frame(spark, DDL, [("b", 3, 1)]))
    assert [tuple(r) for r in began.collect()] == [("a", 1, 1)] == rows(table, 1)
    assert rows(table) == [("a", 9, 1), ("b", 3, 1)]


def test_a_table_may_be_replaced_from_itself(spark, table):
    table.replace(frame(spark, DDL, [("a", 1, 1), ("b", 2, 1)]))
    table.replace(table.read().withColumn("v", F.col("v") * 10))
    assert rows(table) == [("a", 10, 1), ("b", 20, 1)]


def test_upsert_writes_its_own_rows_only_and_compaction_changes_none(spark, table):
    table.replace(frame(spark, DDL, [(c, 1, 1) for c in "abcdef"]))
    base = table.manifest().base
    for v, own in ((2, "bc"), (3, "cg"), (4, "c")):
        new = table.upsert(frame(spark, DDL, [(c, v, s) for c in own for s in (2, 1)] + [(own[0], -v, 0)]))
        assert new.base == base
        assert {r.k for r in spark.read.parquet(f"{table.path}/{new.deltas[-1]}").collect()} == set(own)
    want = [("a", 1, 1), ("b", 2, 2), ("c", 4, 2), ("d", 1, 1), ("e", 1, 1), ("f", 1, 1), ("g", 3, 2)]
    assert rows(table) == want
    after = table.compact()
    assert rows(table) == want and not after.deltas and len(after.base) == 1 and table.compact() == after


def test_many_deltas_are_folded_in(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), ["k"], "seq", most_deltas=2)
    for n in range(5):
        table.upsert(frame(spark, DDL, [("a", n, 1), (f"n{n}", n, 1)]))
    assert len(table.manifest().deltas) <= 2 and rows(table) == [("a", 4, 1), *((f"n{n}", n, 1) for n in range(5))]


def test_a_replayed_batch_changes_nothing(spark, table):
    table.upsert(frame(spark, DDL, [("a", 1, 1)]), "live", 0)
    table.upsert(frame(spark, DDL, [("a", 2, 1)]), "live", 1)
    before = table.manifest()
    for batch, write in ((0, table.upsert), (1, table.upsert), (1, table.replace), (0, table.append)):
        assert write(frame(spark, DDL, [("a", 7, 9)]), "live", batch) == before
    assert table.upsert(frame(spark, DDL, [("b", 1, 1)]), "other", 0).batches == {"live": 1, "other": 0}


def test_two_writers_of_one_version(spark, table, monkeypatch):
    table.replace(frame(spark, DDL, [("a", 1, 1)]))
    other, seen = SnapshotTable(spark, table.path, ["k"], "seq"), table.manifest()
    monkeypatch.setattr(other, "manifest", lambda version=None: seen)
    table.upsert(frame(spark, DDL, [("a", 2, 1)]))
    with pytest.raises(CommitConflict):
        other.upsert(frame(spark, DDL, [("a", 3, 1)]))
    assert rows(table) == [("a", 2, 1)]


def test_ranges_are_replaced_and_null_is_a_value(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    table.replace_where(frame(spark, DDL, [("a", 1, 1), ("a", 2, 2), ("b", 3, 1), (None, 4, 1)]), ["k"])
    table.replace_where(frame(spark, DDL, [("a", 9, 1), (None, 8, 1)]), ["k"])
    assert sorted(map(str, rows_of(table))) == sorted(map(str, [("a", 9, 1), ("b", 3, 1), (None, 8, 1)]))


def rows_of(table):
    return [tuple(r) for r in table.read().collect()]


def test_new_columns_and_expiry(spark, table):
    table.replace(frame(spark, DDL, [("a", 1, 1)]))
    table.upsert(frame(spark, DDL + ", note string", [("b", 2, 1, "x")]))
    assert rows_of(table) and sorted(map(str, rows_of(table))) == sorted(map(str, [("a", 1, 1, None), ("b", 2, 1, "x")]))
    table.compact()
    gone = table.expire()
    assert len(gone) == 2 and table.versions() == [3] and len(rows_of(table)) == 2
    with pytest.raises(FileNotFoundError):
        table.read(1)


def test_a_table_without_commits(spark, table):
    assert table.versions() == [] and table.manifest().version == 0
    with pytest.raises(FileNotFoundError):
        table.read()
