"""Stored tables with versions: readers, several writers, interruptions."""

import threading
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from herdwatch.operators import storage
from herdwatch.sources import commits, readers, writers
from herdwatch.sources.commits import StoredTable

SHAPE = "tag_id long, date timestamp_ntz, t double"


def at(day, hour=0):
    return datetime(2024, 1, day, hour)


def batch(spark, *items):
    return spark.createDataFrame([*items], SHAPE)


@pytest.fixture
def path(spark, tmp_path):
    where = str(tmp_path / "metrics")
    storage.create_metrics(batch(spark, (1, at(1), 1.0), (2, at(1), 2.0), (1, at(2), 3.0), (9, None, 4.0)), where)
    return where


def found(spark, path, version=None, days=None):
    return sorted((r["tag_id"], r["t"]) for r in storage.read_metrics(spark, path, version, days).collect())


OLD = [(1, 1.0), (1, 3.0), (2, 2.0), (9, 4.0)]


def test_old_versions_stay(spark, path):
    made = storage.save_metrics(batch(spark, (1, at(2), 7.0), (3, at(5), 8.0)), path)
    assert made.number == 1 and made.changed == ["2024-01-02", "2024-01-05"]
    assert found(spark, path, 0) == OLD
    assert found(spark, path, 1) == found(spark, path) == [(1, 1.0), (1, 7.0), (2, 2.0), (3, 8.0), (9, 4.0)]
    assert found(spark, path, days=["none", "2024-01-05"]) == [(3, 8.0), (9, 4.0)]
    with pytest.raises(ValueError, match="no version 5"):
        storage.read_metrics(spark, path, 5)


def test_only_the_batchs_days_are_written(spark, path):
    before = StoredTable(spark, path).version()
    after = storage.save_metrics(batch(spark, (1, at(2), 7.0)), path)
    moved = {k for k in after.parts if after.parts[k] != before.parts[k]}
    assert moved == {"2024-01-02"}


def test_a_reader_keeps_its_version_during_a_save(spark, path):
    taken = storage.read_metrics(spark, path)
    storage.save_metrics(batch(spark, (1, at(1), 100.0), (1, at(2), 100.0), (9, None, 100.0)), path)
    assert sorted((r["tag_id"], r["t"]) for r in taken.collect()) == OLD


def test_readers_write_nothing_while_a_save_is_under_way(spark, path, monkeypatch):
    """A save that has written its rows but not its manifest: readers see the old rows and leave its folder alone."""
    real, seen = StoredTable._commit, []

    def slow(self, version):
        seen.append(found(spark, path))
        return real(self, version)

    monkeypatch.setattr(StoredTable, "_commit", slow)
    storage.save_metrics(batch(spark, (1, at(1), 50.0)), path)
    assert seen == [OLD] and (1, 50.0) in found(spark, path)


def test_an_interrupted_save_leaves_the_table_as_it_was(spark, path, monkeypatch):
    def cut(self, version):
        raise KeyboardInterrupt

    monkeypatch.setattr(StoredTable, "_commit", cut)
    with pytest.raises(KeyboardInterrupt):
        storage.save_metrics(batch(spark, (1, at(1), 50.0)), path)
    monkeypatch.undo()
    assert found(spark, path) == OLD
    storage.save_metrics(batch(spark, (1, at(1), 51.0)), path)
    assert found(spark, path) == [(1, 3.0), (1, 51.0), (2, 2.0), (9, 4.0)]


@pytest.mark.parametrize(("other_day", "writes"), [(2, 1), (1, 2)])
def test_a_writer_that_comes_second(spark, path, monkeypatch, other_day, writes):
    """Other days: only the manifest is made anew. The same day: the merge runs again, over the other's rows."""
    real_commit, real_write, state, count = StoredTable._commit, StoredTable.write, [], []

    def second(self, version):
        if not state:
            state.append(1)
            storage.save_metrics(batch(spark, (5, at(other_day, 3), 5.0)), path)
            count.clear()
            count.append(1)
        return real_commit(self, version)

    def counted(self, *args):
        count.append(1)
        return real_write(self, *args)

    monkeypatch.setattr(StoredTable, "_commit", second)
    monkeypatch.setattr(StoredTable, "write", counted)
    made = storage.save_metrics(batch(spark, (6, at(1), 6.0)), path)
    assert made.number == 2 and len(count) == writes
    assert found(spark, path) == sorted([*OLD, (5, 5.0), (6, 6.0)])


def test_two_writers_at_once_lose_nothing(spark, path):
    def run(tag):
        for i in range(3):
            storage.save_metrics(batch(spark, (tag, at(1, i), float(i)), (tag, at(10 + i), 0.5)), path)

    threads = [threading.Thread(target=run, args=(tag,)) for tag in (100, 200)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert StoredTable(spark, path).numbers() == list(range(7))
    want = [(tag, v) for tag in (100, 200) for v in (0.0, 1.0, 2.0, 0.5, 0.5, 0.5)]
    assert found(spark, path) == sorted([*OLD, *want])


def test_a_batch_of_a_writer_counts_once(spark, path):
    first = storage.save_metrics(batch(spark, (1, at(1), 5.0)), path, writer=("job", 3))
    again = storage.save_metrics(batch(spark, (1, at(1), 6.0)), path, writer=("job", 3))
    other = storage.save_metrics(batch(spark, (1, at(1), 7.0)), path, writer=("else", 0))
    assert (first.number, again.number, other.number) == (1, 1, 2) and other.batches == {"job": 3, "else": 0}


def test_changes_cancel_out_for_unchanged_rows(spark, path):
    storage.save_metrics(batch(spark, (1, at(1), 10.0), (3, at(4), 8.0)), path)
    table = StoredTable(spark, path)
    net = table.changes(0).groupBy("tag_id", "date").agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("t")).alias("t"))
    assert rows(net.select("tag_id", "n", "t").where("n <> 0 or t <> 0")) == [(1, 0, 9.0), (3, 1, 8.0)]
    assert table.changes(-1).where("sign < 0").count() == 0 and table.changes(-1).count() == 5
    assert table.changes(1).count() == 0


def test_forgetting_old_versions_keeps_what_is_needed(spark, path):
    table = StoredTable(spark, path)
    under_way = table.write(batch(spark, (7, at(7), 7.0)), storage.day_of("date"))
    for value in (5.0, 6.0):
        storage.save_metrics(batch(spark, (1, at(1), value)), path)
    dropped = table.forget(2)
    assert len(dropped) == 2 and table.numbers() == [2]
    assert found(spark, path) == [(1, 3.0), (1, 6.0), (2, 2.0), (9, 4.0)]
    assert spark.read.parquet(f"{path}/{under_way['2024-01-07']}").count() == 1
    assert table.forget(99) == [] and table.numbers() == [2]


def test_rows_must_stay_in_their_parts(spark, path):
    with pytest.raises(ValueError, match="one of the keys"):
        storage.save_metrics(batch(spark, (1, at(1), 1.0)), path, keys=("tag_id",))
    with pytest.raises(ValueError, match="left their parts"):
        StoredTable(spark, path).change(["2024-01-01"], lambda r: batch(spark, (1, at(9), 1.0)), storage.day_of("date"))


def test_a_table_is_created_once(spark, path, tmp_path):
    with pytest.raises(FileExistsError):
        storage.create_metrics(batch(spark, (1, at(1), 1.0)), path)
    with pytest.raises(ValueError, match="no table"):
        storage.read_metrics(spark, str(tmp_path / "nothing"))
    empty = str(tmp_path / "empty")
    storage.create_metrics(batch(spark), empty)
    assert found(spark, empty) == []
    storage.save_metrics(batch(spark, (1, at(1), 1.0)), empty)
    assert found(spark, empty) == [(1, 1.0)]


def test_animals_in_buckets(spark, tmp_path):
    path = str(tmp_path / "herd")
    herd = spark.range(50).select(F.concat(F.lit("A"), "id").alias("tag_id"), F.lit("F1").alias("farm_id"))
    storage.create_animals(herd, path, buckets=8)
    new = spark.createDataFrame([("A1", "F2", 1), ("A1", "F3", 2), ("B", "F4", 1)], "tag_id string, farm_id string, n int")
    made = storage.save_animals(new, path, arrival="n")
    assert len(made.changed) <= 2 and len(made.parts) == 8
    got = {r["tag_id"]: r["farm_id"] for r in storage.read_animals(spark, path).collect()}
    assert len(got) == 51 and got["A1"] == "F3" and got["B"] == "F4" and got["A2"] == "F1"
    assert storage.read_animals(spark, path, 0).count() == 50


def test_snapshots_of_one_time_and_of_other_columns(spark, tmp_path):
    path = str(tmp_path)
    writers.save_snapshot(spark.range(3), path, "k", "20240301_000000")
    writers.save_snapshot(spark.range(2).withColumn("more", F.lit(1)), path, "k", "20240401_000000")
    with pytest.raises(FileExistsError, match="20240301"):
        writers.save_snapshot(spark.range(1), path, "k", "20240301_000000")
    newest = readers.latest_snapshot(spark, path, "k")
    assert newest.columns == ["id", "more"] and newest.count() == 2
    assert StoredTable(spark, f"{path}/k").read(0).columns == ["id"]


def test_manifests_on_other_file_systems(spark, tmp_path):
    """The Hadoop way gives the same table; it never replaces a manifest."""
    files = commits.HadoopFiles(spark, f"file://{tmp_path}/h")
    assert files.names("log") == []
    assert files.create("log/1.json", "ä") and not files.create("log/1.json", "b") and files.read("log/1.json") == "ä"
    table = StoredTable(spark, str(tmp_path / "t"))
    table.files = commits.HadoopFiles(spark, table.path)
    table.create(batch(spark, (1, at(1), 1.0)), storage.day_of("date"))
    table.change(["2024-01-02"], lambda r: batch(spark, (2, at(2), 2.0)), storage.day_of("date"))
    assert table.read().count() == 2 and len(table.forget(1)) == 0 and table.numbers() == [1]


def test_a_batch_of_wider_numbers_keeps_the_tables_types(spark, tmp_path):
    path = str(tmp_path / "herd")
    storage.create_animals(spark.createDataFrame([("A", 1), ("B", 2)], "tag_id string, farm int"), path, buckets=2)
    storage.save_animals(spark.createDataFrame([("A", 7), ("C", 8)], "tag_id string, farm bigint"), path)
    got = storage.read_animals(spark, path)
    assert dict(got.dtypes)["farm"] == "int" and rows(got) == [("A", 7), ("B", 2), ("C", 8)]
