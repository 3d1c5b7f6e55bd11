import pytest
from conftest import rows
from pyspark.sql import functions as F

from herdwatch.constants import DetectionSettings
from herdwatch.operators import contracts as ct
from herdwatch.operators import storage
from herdwatch.plans import pipeline, stages
from herdwatch.plans import views as v
from herdwatch.plans.q_detection import enriched
from herdwatch.sources.commits import StoredTable

STAT = DetectionSettings("statistical", threshold=1.5)


def test_switches_and_dependencies():
    assert pipeline.enabled("email_alerts", {}) and not pipeline.enabled("email_alerts", {"notifications": False})
    with pytest.raises(KeyError):
        pipeline.enabled("teleport", {})


def test_run_all_steps(spark, data, tmp_path):
    done = pipeline.run(enriched(spark, data), v.METRICS_AS_OF, settings=STAT, export_to=str(tmp_path))
    assert done.success and {"data_quality", "preprocessing", "anomaly_detection", "notifications", "export_reports", "dashboard"} <= set(done.steps)
    assert "ensemble_detection" not in done.steps
    assert done.tables["detected"].count() == 1000 and done.tables["clusters"].count() > 0
    assert "Data quality issues detected" in done.warnings
    assert spark.read.csv(done.files["anomalies_csv"], header=True).count() == done.tables["detected"].filter("is_anomaly").count()


def test_steps_can_be_switched_off(spark, data):
    off = {"data_quality": False, "notifications": False, "dashboard": False, "preprocessing": False}
    done = pipeline.run(enriched(spark, data), v.METRICS_AS_OF, settings=STAT, switches=off)
    assert done.steps == ["anomaly_detection"] and set(done.tables) == {"detected", "clusters"}


def test_no_anomaly_means_no_notification(spark, data):
    calm = DetectionSettings("statistical", threshold=3.0)
    done = pipeline.run(enriched(spark, data), v.METRICS_AS_OF, settings=calm, switches={"data_quality": False})
    assert "notifications" not in done.steps and "notifications" not in done.tables


def test_strict_mode(spark, data):
    contract = ct.Contract("readings", (ct.ColumnRule("heart_rate", "float", max_value=60),))
    readings = enriched(spark, data)
    stopped = pipeline.run(readings, v.METRICS_AS_OF, settings=STAT, contract=contract, strict=True)
    assert not stopped.success and stopped.errors == ["Data validation failed"] and stopped.steps == []
    on = {"preprocessing": False, "notifications": False, "dashboard": False, "anomaly_detection": False}
    went_on = pipeline.run(readings, v.METRICS_AS_OF, contract=contract, switches=on)
    assert went_on.success and "Data validation failed" in went_on.warnings
    assert went_on.tables["contract_quality"].select(F.col("grade")).first()[0] in "ABCDF"


def test_a_killed_run_goes_on_behind_its_last_stage(spark, data, tmp_path, monkeypatch):
    readings, kept = enriched(spark, data), str(tmp_path / "kept")
    whole = pipeline.run(readings, v.METRICS_AS_OF, settings=STAT, export_to=str(tmp_path / "a"))
    real = pipeline.ensemble.detect

    def killed(*args, **kwargs):
        raise KeyboardInterrupt

    monkeypatch.setattr(pipeline.ensemble, "detect", killed)
    with pytest.raises(KeyboardInterrupt):
        pipeline.run(readings, v.METRICS_AS_OF, settings=STAT, export_to=str(tmp_path / "b"), resume_at=kept)
    monkeypatch.setattr(pipeline.ensemble, "detect", real)
    # A folder that the killed run was writing has no record.
    spark.range(3).write.parquet(f"{kept}/tables/detected-half")
    monkeypatch.setattr(pipeline.clean, "clean", killed)
    again = pipeline.run(readings, v.METRICS_AS_OF, settings=STAT, export_to=str(tmp_path / "b"), resume_at=kept)
    assert again.stages.made == ["detected", "exported"]
    third = pipeline.run(readings, v.METRICS_AS_OF, settings=STAT, export_to=str(tmp_path / "b"), resume_at=kept)
    assert third.stages.made == [] and third.files == again.files and third.steps == again.steps == whole.steps
    for name in ("cleaned", "detected", "clusters"):
        assert rows(third.tables[name]) == rows(whole.tables[name]), name


def test_other_input_or_settings_are_computed_anew(spark, data, tmp_path):
    readings, kept = enriched(spark, data), str(tmp_path / "kept")
    off = {"data_quality": False, "notifications": False, "dashboard": False}
    first = pipeline.run(readings, v.METRICS_AS_OF, settings=STAT, switches=off, resume_at=kept)
    assert first.stages.made == ["cleaned", "detected"]
    other = DetectionSettings("statistical", threshold=2.0)
    second = pipeline.run(readings, v.METRICS_AS_OF, settings=other, switches=off, resume_at=kept)
    assert second.stages.made == ["detected"]
    fewer = pipeline.run(readings.filter("arrival_id <> 5"), v.METRICS_AS_OF, settings=STAT, switches=off, resume_at=kept)
    assert fewer.stages.made == ["cleaned", "detected"] and fewer.tables["cleaned"].count() == first.tables["cleaned"].count() - 1
    # Only the last run's tables stay.
    assert len(fewer.stages.forget_others()) == 6
    assert fewer.tables["detected"].count() == fewer.tables["cleaned"].count()
    assert pipeline.run(readings, v.METRICS_AS_OF, settings=STAT, switches=off, resume_at=kept).stages.made == ["cleaned", "detected"]


def test_a_stored_table_is_known_by_its_version(spark, tmp_path):
    path = str(tmp_path / "t")
    shape = "tag_id long, date timestamp_ntz, t double"
    storage.create_metrics(spark.createDataFrame([], shape), path)
    table = StoredTable(spark, path)
    first = stages.stored_input(table)
    storage.save_metrics(spark.createDataFrame([(1, None, 1.0)], shape), path)
    assert stages.stored_input(table) != first
    assert stages.input_of(spark.range(3)) == stages.input_of(spark.range(3).repartition(2)) != stages.input_of(spark.range(4))
