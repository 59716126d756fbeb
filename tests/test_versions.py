import threading

import pytest
from pyspark.sql import functions as F

from cohortkit.sources import versions as V

DDL = "k long, v string"


@pytest.fixture
def table(spark, tmp_path):
    t = V.VersionedTable(spark, str(tmp_path / "t"))
    t.overwrite(spark.createDataFrame([(1, "a"), (2, "b")], DDL))
    return t


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_table_can_replace_its_own_source(spark, table):
    old = table.read()
    assert table.overwrite(table.read().withColumn("v", F.concat("v", F.lit("!"))).filter("k > 1")) == 2
    assert rows(table.read()) == [(2, "b!")]
    assert rows(table.read(1)) == rows(old) == [(1, "a"), (2, "b")]      # earlier readers keep their version
    with pytest.raises(FileNotFoundError):
        table.read(9)
    with pytest.raises(FileNotFoundError):
        V.VersionedTable(spark, table.path + "x").read()


def test_a_failed_overwrite_leaves_the_table(spark, table):
    bad = table.read().withColumn("v", F.when(F.col("k") == 2, F.raise_error(F.lit("broken"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken"):
        table.overwrite(bad)
    assert rows(table.read()) == [(1, "a"), (2, "b")] and table.version().number == 1


def test_a_batch_is_inserted_once(spark, table):
    batch = spark.createDataFrame([(2, "x"), (3, "c"), (3, "d"), (4, None)], DDL)
    assert table.insert_once(batch, "k", "monday", order=["v"]) == 2
    want = [(1, "a"), (2, "b"), (3, "c"), (4, None)]
    assert rows(table.read()) == want
    assert table.insert_once(batch, "k", "monday", order=["v"]) == 2 and table.version().number == 2
    assert table.insert_once(spark.createDataFrame([(5, "other rows")], DDL), "k", "monday") == 2       # the name decides
    assert table.insert_once(batch, "k", "tuesday") == 0 and rows(table.read()) == want
    table.compact(1)
    assert table.insert_once(batch, "k", "monday") == 2 and rows(table.read()) == want
    assert len(table.read().inputFiles()) == 1


def test_a_try_that_fails_before_publishing_changes_nothing_and_can_be_repeated(spark, table, monkeypatch):
    batch = spark.createDataFrame([(3, "c")], DDL)

    def lost(self, version):
        raise OSError("driver lost")
    with monkeypatch.context() as m:
        m.setattr(V.VersionedTable, "_publish", lost)
        with pytest.raises(OSError):
            table.insert_once(batch, "k", "monday")
    assert rows(table.read()) == [(1, "a"), (2, "b")]
    assert table.insert_once(batch, "k", "monday") == 1
    assert rows(table.read()) == [(1, "a"), (2, "b"), (3, "c")]
    assert len(table.prune(keep=1)) == 1                      # the folder of the failed try
    assert rows(table.read()) == [(1, "a"), (2, "b"), (3, "c")] and table.version(1) is None


def test_two_writers_at_once_insert_each_key_once(spark, table):
    batches = {f"w{i}": spark.createDataFrame([(k, f"w{i}") for k in range(10, 10 + 5 * (i + 1))], DDL) for i in range(3)}
    threads = [threading.Thread(target=table.insert_once, args=(b, "k", n)) for n, b in batches.items()]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    keys = [r["k"] for r in table.read().collect()]
    assert sorted(keys) == [1, 2, *range(10, 25)]
    assert set(table.version().batches) == set(batches) and sum(table.version().batches.values()) == 15


def test_a_taken_version_is_a_conflict(table):
    with pytest.raises(V.Conflict):
        table._publish(V.Version(1, [], {}, "{}"))


def test_empty_tables_and_batches(spark, tmp_path):
    t = V.VersionedTable(spark, str(tmp_path / "e"))
    t.overwrite(spark.createDataFrame([], DDL))
    assert rows(t.read()) == [] and t.insert_once(spark.createDataFrame([], DDL), "k", "none") == 0
    assert t.insert_once(spark.createDataFrame([(None, "n"), (1, "a")], DDL), "k", "first") >= 1
