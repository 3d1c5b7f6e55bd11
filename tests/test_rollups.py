"""Stored rollups and bitmaps equal a full recount after any saves."""

from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from herdwatch.operators import reports, rollups, storage
from herdwatch.sources.commits import StoredTable

SHAPE = "tag_id string, date timestamp_ntz, farm_id string, animal_type string, is_anomaly boolean, anomaly_score double"


def reading(i, day, score=None, farm="F1", kind="cattle"):
    return (None if i is None else f"A{i}", None if day is None else datetime(2024, 1, day, (i or 0) % 24), farm, kind, score is not None, score)


SAVES = [
    [reading(i, 1 + i % 4, [None, 0.1, 0.7][i % 3], f"F{i % 3}", ["cattle", "goat", None][i % 3]) for i in range(60)],
    # Other scores, another farm, new animals, a day that was not there, no date.
    [reading(i, 1 + i % 4, 0.2, "F9", "swine") for i in range(0, 60, 7)] + [reading(100, 9, 5.0), reading(101, None, 1.0)],
    [reading(i, 1 + i % 4, float("nan"), None, None) for i in range(1, 60, 14)] + [reading(102, 3, 1e300), reading(103, 3, None)],
]


@pytest.fixture
def saved(spark, tmp_path):
    """Saves and refreshes in turn; (source, rollup, sets)."""
    source = str(tmp_path / "readings")
    roll = rollups.readings_rollup(spark, source, str(tmp_path / "rollup"))
    sets = rollups.AnimalSets(spark, source, str(tmp_path / "numbers"), str(tmp_path / "sets"), {"animal_type": F.col("animal_type")})
    for i, items in enumerate(SAVES):
        batch = spark.createDataFrame(items, SHAPE)
        storage.save_metrics(batch, source) if i else storage.create_metrics(batch, source)
        roll.refresh()
        sets.refresh()
    return source, roll, sets


def recount(df):
    ok = ~F.isnan("anomaly_score") & (F.abs("anomaly_score") < 1e25)
    return df.groupBy(F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("none")).alias("day"), "farm_id", "animal_type").agg(
        F.count("*").alias("rows"), F.count_if("is_anomaly").alias("anomalies"), F.coalesce(F.sum(F.when(ok, F.col("anomaly_score"))), F.lit(0.0)).alias("score"),
    )


def test_three_saves_equal_a_recount(spark, saved):
    source, roll, sets = saved
    now = storage.read_metrics(spark, source)
    columns = ["day", "farm_id", "animal_type", "rows", "anomalies"]
    got = roll.read().withColumn("score", F.col("score").cast("double"))
    assert rows(got.select(*columns, "score")) == rows(recount(now).select(*columns, "score"))
    # Sums of what was added and taken back leave nothing.
    assert roll.read().where("rows <= 0").count() == 0
    want = now.where("tag_id is not null").groupBy("animal_type").agg(F.count_distinct("tag_id").alias("n"))
    assert rows(rollups.distinct_animals(sets.read(), "animal_type")) == rows(want)
    assert rollups.distinct_animals(sets.read()).first()[0] == now.select("tag_id").distinct().count()


def test_a_refresh_reads_changed_days_only(spark, saved, tmp_path):
    source, roll, _ = saved
    before = roll.table.version()
    storage.save_metrics(spark.createDataFrame([reading(7, 2, 3.0)], SHAPE), source)
    after = roll.refresh()
    assert {k for k in after.parts if after.parts[k] != before.parts[k]} == {"2024-01-02"}
    assert roll.refresh().number == after.number
    # Several versions at once, and a change that was taken back.
    for value in (4.0, 3.0):
        storage.save_metrics(spark.createDataFrame([reading(7, 2, value)], SHAPE), source)
    again = roll.refresh()
    assert again.number == after.number + 1
    assert rows(roll.read().select("day", "rows", "score")) == rows(roll.table.read(after.number).select("day", "rows", "score"))


def test_two_refreshes_at_once_count_once(spark, saved, monkeypatch):
    """The second one finds that the first has noted this version of the source, and changes nothing."""
    source, roll, _ = saved
    storage.save_metrics(spark.createDataFrame([reading(200, 1, 1.0)], SHAPE), source)
    real, state = StoredTable._commit, []

    def first_come(self, version):
        if not state:
            state.append(1)
            rollups.readings_rollup(spark, source, roll.table.path).refresh()
        return real(self, version)

    monkeypatch.setattr(StoredTable, "_commit", first_come)
    roll.refresh()
    assert roll.read().agg(F.sum("rows")).first()[0] == storage.read_metrics(spark, source).count()


def test_numbers_stay_dense_and_fixed(spark, tmp_path):
    path = str(tmp_path / "n")
    herd = lambda *names: spark.createDataFrame([(n,) for n in names], "tag_id string")
    rollups.number_animals(herd("b", "a", None, "a"), path)
    first = {r["tag_id"]: r["number"] for r in StoredTable(spark, path).read().collect()}
    rollups.number_animals(herd("c", "a", "d"), path)
    rollups.number_animals(herd("c"), path)
    second = {r["tag_id"]: r["number"] for r in StoredTable(spark, path).read().collect()}
    assert first == {"a": 1, "b": 2} and second == {**first, "c": 3, "d": 4}


def test_bitmaps_over_several_buckets(spark):
    rows_ = spark.range(100_000).select((F.col("id") % 70_000 + 1).alias("n"), (F.col("id") % 2).alias("k"))
    bucket, position = rollups.bits(F.col("n"))
    sets = rows_.groupBy("k", bucket.alias("bucket")).agg(F.bitmap_construct_agg(position).alias("animals"))
    assert sets.select("bucket").distinct().count() == 3
    assert rollups.distinct_animals(sets).first()[0] == 70_000
    assert rows(rollups.distinct_animals(sets, "k")) == [(0, 35_000), (1, 35_000)]
    assert rollups.distinct_animals(sets.limit(0)).first()[0] == 0


def test_plans_do_not_expand_rows(spark, saved):
    _, roll, sets = saved
    for df in (rollups.summary(roll.read(), sets.read()), rollups.daily_figures(roll.read(), sets.read()), rollups.type_shares(roll.read(), sets.read())):
        assert "Expand" not in df._jdf.queryExecution().executedPlan().toString()


def test_figures_equal_the_reports_over_all_readings(spark, saved):
    source, roll, sets = saved
    now = storage.read_metrics(spark, source)
    got = rollups.summary(roll.read(), sets.read())
    want = reports.metrics_summary(now, "2024-02-01 00:00:00", None)
    assert rows(got.select(*want.columns)) == rows(want)
    assert rows(rollups.type_shares(roll.read(), sets.read())) == rows(reports.type_distribution(now))
    recent = rollups.days_since(roll.table.version(), "2024-01-05 00:00:00", 2)
    assert recent == ["2024-01-03", "2024-01-04", "2024-01-09"]


def test_rollups_of_an_empty_table(spark, tmp_path):
    source = str(tmp_path / "s")
    storage.create_metrics(spark.createDataFrame([], SHAPE), source)
    roll = rollups.readings_rollup(spark, source, str(tmp_path / "r"))
    assert roll.refresh().number == 0 and roll.read().count() == 0
    storage.save_metrics(spark.createDataFrame([reading(1, 1, 1.0)], SHAPE), source)
    roll.refresh()
    assert roll.read().count() == 1
    with pytest.raises(ValueError, match="no table"):
        rollups.readings_rollup(spark, str(tmp_path / "none"), str(tmp_path / "r2")).refresh()


def test_herd_figures(spark):
    herd = spark.createDataFrame([("cattle", "F1", True), ("cattle", None, True), (None, None, True), ("goat", "F2", False)], "animal_type string, farm_id string, is_active boolean")
    assert rows(rollups.herd_figures(herd)) == rows(reports.animal_summary(herd))
