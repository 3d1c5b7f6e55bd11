"""Streams over several micro-batches give what the batch operators give."""

import time
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from herdwatch.constants import METRICS
from herdwatch.operators import contracts as ct
from herdwatch.operators import detect, storage
from herdwatch.streaming import jobs

START = datetime(2024, 1, 4)


def files(parts, folder):
    """One file per part, in order of time."""
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(folder))
        if i < len(parts) - 1:
            time.sleep(1.1)
    return str(folder)


@pytest.fixture(scope="module")
def readings(spark):
    out = [
        (i, f"A{i % 3}", START + timedelta(hours=i), 38 + (i * 7 % 11) / 5, None if i % 5 == 0 else 60.0 + i * 13 % 17, 1.0)
        for i in range(60)
    ]
    return spark.createDataFrame(out, "arrival_id long, tag_id string, date timestamp, temperature double, heart_rate double, activity_level double")


Z_COLUMNS = ["arrival_id", *[f"{m}_zscore" for m in METRICS]]


def scored(spark, parts, folder, **options):
    """Runs the job once after each part has arrived, the last time after a tick; (on time, late) rows."""
    source, schema = str(folder / "in"), parts[0].schema
    for part in parts:
        part.write.mode("append").parquet(source)
        jobs.rolling_scores(jobs.read_files(spark, source, schema), str(folder / "out"), str(folder / "state"), **options).awaitTermination()
    jobs.tick(spark, source, schema, START + timedelta(days=400))
    jobs.rolling_scores(jobs.read_files(spark, source, schema), str(folder / "out"), str(folder / "state"), **options).awaitTermination()
    out = jobs.read_flagged(spark, str(folder / "out"))
    return out.where("not late").select(*Z_COLUMNS), out.where("late").select(*Z_COLUMNS)


def test_rolling_scores_across_batches(spark, readings, tmp_path):
    parts = [readings.filter(F.col("arrival_id").between(a, a + 19)) for a in (0, 20, 40)]
    source = files(parts, tmp_path / "in")
    jobs.tick(spark, source, readings.schema, START + timedelta(days=400))
    stream = jobs.read_files(spark, source, readings.schema, files_per_batch=1)
    query = jobs.rolling_scores(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"] > 0]) >= 3
    want = detect.rolling_zscore(readings).select(*Z_COLUMNS)
    out = jobs.read_flagged(spark, str(tmp_path / "out"))
    assert rows(out.select(*Z_COLUMNS)) == rows(want) and not out.where("late").count()


def test_rolling_scores_of_unordered_batches(spark, readings, tmp_path):
    """Batches that each reach over the whole time, with a delay as long; an animal with most of the rows."""
    hot = readings.withColumn("tag_id", F.when(F.col("arrival_id") % 7 > 0, "hot").otherwise(F.col("tag_id")))
    parts = [hot.filter(F.xxhash64("arrival_id") % 3 == k) for k in (-2, -1, 0, 1, 2)]
    on_time, late = scored(spark, parts, tmp_path, delay="10 days", piece_hours=5)
    assert rows(on_time) == rows(detect.rolling_zscore(hot).select(*Z_COLUMNS)) and late.count() == 0


def test_late_and_undated_readings_are_set_apart(spark, readings, tmp_path):
    nameless = readings.filter("arrival_id = 1").withColumns({"arrival_id": F.lit(99).cast("long"), "date": F.lit(None).cast("timestamp")})
    late_ones = readings.filter("arrival_id in (3, 4, 30)").unionByName(nameless)
    kept = readings.filter("arrival_id not in (3, 4, 30)")
    parts = [kept.filter("arrival_id < 40"), kept.filter("arrival_id >= 40 and arrival_id < 50"), late_ones.unionByName(kept.filter("arrival_id >= 50"))]
    on_time, late = scored(spark, parts, tmp_path, delay="5 hours", piece_hours=2)
    assert rows(on_time) == rows(detect.rolling_zscore(kept).select(*Z_COLUMNS))
    assert rows(late) == [(i, None, None, None) for i in (3, 30, 4, 99)]


def test_a_window_of_one_keeps_no_values():
    processor = jobs.RollingScores(["tag_id"], ["t"], 1, 1)

    class Held:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    import pandas as pd

    processor.last = Held()
    processor._scored(pd.DataFrame({"tag_id": ["a"] * 3, "t": [1.0, 2.0, 3.0]}))
    assert processor.last.value == ([],)


def test_animals_share_state_in_groups(spark, tmp_path):
    """State entries grow with groups and pieces, not with animals; each animal is scored by its own readings."""
    rows_in = spark.range(3000).select(
        F.concat(F.lit("T"), (F.col("id") % 300).cast("string")).alias("tag_id"),
        F.timestamp_seconds(1704067200 + F.col("id") * 60).alias("date"), F.col("id").alias("arrival_id"),
        *[(F.xxhash64("id", F.lit(m)) % 50).cast("double").alias(m) for m in ("temperature", "heart_rate", "activity_level")],
    )
    source = files([rows_in], tmp_path / "in")
    query = jobs.rolling_scores(jobs.read_files(spark, source, rows_in.schema), str(tmp_path / "out"), str(tmp_path / "state"), spread=4, delay="400 days")
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) < 300
    jobs.tick(spark, source, rows_in.schema, START + timedelta(days=900))
    jobs.rolling_scores(jobs.read_files(spark, source, rows_in.schema), str(tmp_path / "out"), str(tmp_path / "state"), spread=4, delay="400 days").awaitTermination()
    out = jobs.read_flagged(spark, str(tmp_path / "out"))
    assert rows(out.select(*Z_COLUMNS)) == rows(detect.rolling_zscore(rows_in).select(*Z_COLUMNS)) and not out.where("late").count()


def test_every_row_is_accounted_for(spark, tmp_path):
    """Rows in are rows out, copies and late rows, whatever their types; the late ones are kept."""
    shape = "tag_id string, date timestamp, n long, x double, f array<int>, s struct<a:string,b:timestamp>"
    def make(*items):
        return spark.createDataFrame([(t, None if d is None else START + timedelta(days=d, microseconds=7), 2**53 + 1, 0.1, [1, None], (None, START)) for t, d in items], shape)
    arrivals = [make(("A", 0), ("A", 0), ("B", 1)), make(("C", 30), ("A", 0)), make(("D", 2), ("C", 30), ("E", 31), (None, None)), make(("F", 3), ("F", 60))]
    accounts = jobs.Accounts()
    spark.streams.addListener(accounts)
    try:
        for part in arrivals:
            part.write.mode("append").parquet(str(tmp_path / "in"))
            gate = jobs.flag_late(jobs.read_files(spark, str(tmp_path / "in"), shape), str(tmp_path / "gate"), str(tmp_path / "s1"), delay="5 days", spread=3)
            gate.awaitTermination()
            first = accounts.of(gate)
        unique = jobs.dedup(jobs.on_time(spark, str(tmp_path / "gate"), make().schema), str(tmp_path / "out"), str(tmp_path / "s2"), delay="5 days")
        unique.awaitTermination()
        second = accounts.of(unique)
    finally:
        spark.streams.removeListener(accounts)
    late = jobs.read_flagged(spark, str(tmp_path / "gate")).where("late")
    # A's third row is behind the first batch's mark, D's and F's first ones are behind the 25th day.
    assert sorted(r["tag_id"] for r in late.collect()) == ["D", "F"]
    assert (first["in"], first["out"], first["late"], first["dropped"]) == (11, 11, 2, 0)
    assert second["dropped"] == 0 and second["in"] - second["copies"] == second["out"] == spark.read.parquet(str(tmp_path / "out")).count()
    assert first["in"] == second["out"] + second["copies"] + first["late"]
    row = spark.read.parquet(str(tmp_path / "out")).where("tag_id = 'E'").first()
    assert (row["date"], row["n"], row["x"], row["f"], row["s"]["a"], row["s"]["b"]) == (START + timedelta(days=31, microseconds=7), 2**53 + 1, 0.1, [1, None], None, START)


def test_late_rows_do_not_reach_closed_windows(spark, tmp_path):
    shape = "tag_id string, date timestamp, farm_id string, animal_type string, is_anomaly boolean, anomaly_score double"
    def make(*items):
        return spark.createDataFrame([(t, START + timedelta(days=d), "F", "cattle", True, 2.0) for t, d in items], shape)
    source = files([make(("A", 0), ("B", 1), ("B", 2)), make(("C", 20), ("C", 20), ("D", 21)), make(("D", 22)), make(("Z", 3)), make(("E", 40))], tmp_path / "in")
    stream = jobs.read_files(spark, source, shape, files_per_batch=1)
    jobs.clusters(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("start_date").collect()
    # The watermark of a batch counts for lateness from the next batch on, so Z comes too late.
    assert [(r["start_date"], r["anomaly_rows"], r["affected_animals"]) for r in got] == [(START, 3, 2)]


def test_dedup_across_batches(spark, tmp_path):
    shape = "tag_id string, date timestamp, v int"
    parts = [spark.createDataFrame([("A", START, 1), ("B", START, 1)], shape), spark.createDataFrame([("A", START, 2), ("C", START, 2)], shape)]
    stream = jobs.read_files(spark, files(parts, tmp_path / "in"), shape, files_per_batch=1)
    jobs.dedup(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("tag_id", "v")) == [("A", 1), ("B", 1), ("C", 2)]


def test_validate_splits_each_batch(spark, tmp_path):
    contract = ct.Contract("c", (ct.ColumnRule("id", "integer", min_value=1),), required=("id",))
    parts = [spark.createDataFrame([(1,), (0,)], "id int"), spark.createDataFrame([(None,), (5,)], "id int")]
    stream = jobs.read_files(spark, files(parts, tmp_path / "in"), "id int", files_per_batch=1)
    jobs.validate(stream, contract, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "state")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "good")).select("id")) == [(1,), (5,)]
    bad = spark.read.parquet(str(tmp_path / "bad"))
    assert sorted(len(r["errors"]) for r in bad.collect()) == [1, 2] and bad.select("batch").distinct().count() == 2


def test_upsert_batches(spark, readings, tmp_path):
    table = str(tmp_path / "table")
    storage.create_metrics(readings.filter("arrival_id < 10").drop("arrival_id").withColumn("temperature", F.lit(0.0)), table)
    parts = [readings.filter("arrival_id < 30"), readings.filter("arrival_id >= 20").withColumn("temperature", F.lit(1.0))]
    stream = jobs.read_files(spark, files(parts, tmp_path / "in"), readings.schema, files_per_batch=1)
    jobs.upsert_readings(stream, table, str(tmp_path / "state")).awaitTermination()
    got = storage.read_metrics(spark, table)
    assert got.count() == 60 and got.filter("temperature = 1.0").count() == 40 and got.filter("temperature = 0.0").count() == 0
