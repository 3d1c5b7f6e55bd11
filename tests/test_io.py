import gzip
import json
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from herdwatch.operators import alerts as al
from herdwatch.operators import joins, logs, reports, storage
from herdwatch.sources import readers, writers
from herdwatch.sources.commits import StoredTable

DAY = datetime(2024, 1, 1)


def test_csv_json_and_dispatch(spark, tmp_path):
    (tmp_path / "a.csv").write_text("tag_id,date,temperature,note\nA,2024-01-01,38.5,x\nB,bad,hot,\n")
    got = readers.read_any(spark, str(tmp_path / "a.csv"))
    assert rows(got) == [("A", DAY, 38.5, "x"), ("B", None, None, None)]
    (tmp_path / "one.json").write_text('{"tag_id": "A", "date": "2024-01-01"}')
    (tmp_path / "many.json").write_text('[{"tag_id": "A", "date": "2024-01-01"}, {"tag_id": "B", "date": "x"}]')
    assert rows(readers.read_any(spark, str(tmp_path / "one.json")).select("tag_id", "date")) == [("A", DAY)]
    assert rows(readers.read_any(spark, str(tmp_path / "many.json")).select("tag_id", "date")) == [("A", DAY), ("B", None)]
    spark.range(3).write.parquet(str(tmp_path / "p.parquet"))
    assert readers.read_any(spark, str(tmp_path / "p.parquet")).count() == 3
    with pytest.raises(ValueError):
        readers.read_any(spark, "x.xlsx")


def test_check_readings(spark):
    ok = spark.createDataFrame([("A", DAY)], "tag_id string, date timestamp")
    readers.check_readings(ok)
    with pytest.raises(ValueError, match="missing"):
        readers.check_readings(ok, ["farm_id"])
    with pytest.raises(ValueError, match="null"):
        readers.check_readings(ok.unionByName(spark.createDataFrame([(None, DAY)], ok.schema)))


def test_sql_parameters(spark):
    got = readers.run_sql(spark, "SELECT count(*) AS n FROM t WHERE id >= :low", {"t": spark.range(10)}, low=7)
    assert got.first()["n"] == 3


RECORDS = [
    {"timestamp": "2024-01-01T10:00:00Z", "level": "INFO", "message": "start", "logger": "a", "operation": "load", "duration_ms": 100},
    {"timestamp": "2024-01-01T11:00:00Z", "level": "ERROR", "message": "boom", "logger": "b", "module": "db"},
    {"timestamp": "2024-01-01T12:00:00Z", "level": "WARNING", "message": "slow", "operation": "load", "duration_ms": 150},
    {"timestamp": "2024-01-01T13:00:00Z", "message": "no level", "operation": "save", "duration_ms": "50"},
]


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    (folder / "app.log").write_text(
        json.dumps(RECORDS[0]) + "\nplain text {not json}\n{}\n[1]\n" + "prefix | " + json.dumps(RECORDS[1]) + " tail\n"
    )
    with gzip.open(folder / "app.log.1.gz", "wt") as f:
        f.write("  " + json.dumps(RECORDS[2]) + "\n")
    (folder / "app.log.2").write_text(json.dumps(RECORDS[3]) + "\n" + json.dumps(RECORDS[0])[:-5] + "\n")
    (folder / "other.txt").write_text(json.dumps(RECORDS[0]) + "\n")
    return logs.parse_lines(readers.read_log_lines(spark, str(folder)))


def test_log_lines(parsed):
    got = sorted((r["message"], r["duration_ms"]) for r in parsed.collect())
    assert got == [("boom", None), ("no level", 50.0), ("slow", 150.0), ("start", 100.0)]


def test_log_reports(parsed):
    assert {r["message"] for r in logs.read_logs(parsed, level="WARNING").collect()} == {"boom", "slow"}
    assert {r["message"] for r in logs.read_logs(parsed, level="DEBUG").collect()} == {"boom", "slow", "start", "no level"}
    window = logs.read_logs(parsed, since="2024-01-01 11:00:00", until="2024-01-01 12:00:00")
    assert {r["message"] for r in window.collect()} == {"boom", "slow"}
    perf = {r["operation"]: r for r in logs.performance(parsed).collect()}
    assert perf["load"]["avg_ms"] == 125 and perf["load"]["p95_ms"] == 150 and perf["save"]["count"] == 1
    assert rows(logs.slowest(parsed, limit=1).select("operation")) == [("load",)]
    assert rows(logs.errors_by(parsed, "module")) == [("db", 1)]
    assert rows(logs.errors_by(parsed, "function")) == [("Unknown", 1)]
    assert rows(logs.top_errors(parsed)) == [("boom", 1)]
    assert logs.search_logs(parsed, "BOOM").count() == 1 and logs.search_logs(parsed, "BOOM", case_sensitive=True).count() == 0
    summary = {(r["section"], r["key"]): r["value"] for r in logs.log_summary(parsed, tie="message").collect()}
    assert summary[("level_distribution", "UNKNOWN")] == "1" and summary[("total", "total_logs")] == "4"


def test_export(spark, tmp_path):
    df = spark.createDataFrame([("A", DAY, 1.5, ["x", "y"])], "tag_id string, date timestamp_ntz, temperature double, l array<string>")
    done = writers.export(df, str(tmp_path), "t", "2024-01-02 00:00:00", ("csv", "excel", "json"), summary=True)
    assert set(done) == {"csv", "json", "summary"}
    assert rows(readers.read_csv(spark, done["csv"])) == [("A", DAY, 1.5, '["x","y"]')]
    about = spark.read.json(f"{done['json']}/metadata").first()
    assert about["record_count"] == 1 and about["columns"] == df.columns and about["export_date"] == "2024-01-02T00:00:00"
    assert spark.read.parquet(done["summary"]).first()["mean"] == 1.5
    assert writers.export(df.limit(0), str(tmp_path), "empty", "2024-01-02 00:00:00") == {}
    assert writers.essential_columns(df) == ["tag_id", "date", "temperature"]
    plain = writers.export_anomalies(df, str(tmp_path), "2024-01-02 00:00:00", details=False)
    assert spark.read.csv(plain["csv"], header=True).columns == ["tag_id", "date", "temperature"]


def test_json_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([("A", None)], "a string, b double")
    path = writers.write_json(df, str(tmp_path / "j"), "2024-01-02 00:00:00")
    assert json.loads(spark.read.text(f"{path}/data").first()["value"]) == {"a": "A", "b": None}


ALERTS = [(1, "FARM-1", "critical", "fever", 12, False), (2, "FARM-2", None, "cough", None, True), (3, None, "odd", None, 3, False)]
ALERT_SHAPE = "id bigint, farm_id string, severity string, message string, affected_animals bigint, is_resolved boolean"


def test_alert_log(spark, tmp_path):
    alerts = spark.createDataFrame(ALERTS, ALERT_SHAPE)
    path = str(tmp_path / "log")
    writers.log_alerts(alerts.filter("id = 1"), path, "2024-01-01 08:00:00")
    writers.log_alerts(alerts.filter("id > 1"), path, "2024-01-03 09:30:00")
    got = readers.recent_alerts(spark, path, "2024-01-03 12:00:00", 7).collect()
    assert [r["day"].day for r in got] == [3, 3, 1] and {r["severity"] for r in got} == {"critical", "info", "odd"}
    assert readers.recent_alerts(spark, path, "2024-01-03 12:00:00", 2).count() == 2
    lines = {r["line"] for r in readers.todays_alert_lines(spark, path, "2024-01-03 12:00:00").collect()}
    assert lines == {"[2024-01-03 09:30:00] [INFO] Farm: FARM-2 | Animals: 0 | cough",
                     "[2024-01-03 09:30:00] [ODD] Farm: UNKNOWN | Animals: 3 | No message"}
    plan = readers.recent_alerts(spark, path, "2024-01-03 12:00:00", 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_alert_search_and_threshold(spark):
    alerts = spark.createDataFrame(ALERTS, ALERT_SHAPE).withColumn("created_at", F.lit(DAY))
    assert rows(al.search(alerts, keyword="FEV").select("id")) == [(1,)]
    assert rows(al.search(alerts, severity="CRITICAL", farm_id="farm-1").select("id")) == [(1,)]
    assert rows(al.over_threshold(alerts, "low").select("id")) == [(1,), (2,)]
    assert rows(al.over_threshold(alerts, "nothing").select("id")) == [(1,), (2,), (3,)]
    got = {(r["section"], r["key"]): r["alerts"] for r in al.stats(alerts).collect()}
    assert got[("by_severity", "unknown")] == 1 and got[("by_farm", "unknown")] == 1
    assert got[("total_alerts", "all")] == 3 and got[("daily_count", "2024-01-01")] == 3


def test_alert_body_leaves_out_what_is_missing(spark):
    df = spark.createDataFrame([("F", "high", 3, 2.345, ["cattle", "goat"], None)],
                               "farm_id string, severity string, affected_animals int, avg_anomaly_score double, "
                               "animal_types array<string>, description string")
    text = df.select(al.body(df, "2024-01-01 00:00:00")).first()[0]
    assert "Average Anomaly Score: 2.35" in text or "Average Anomaly Score: 2.34" in text
    assert "Animal Types: cattle, goat" in text and "Description" not in text and "4. Contact veterinary services" in text


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "snap")
    assert readers.latest_snapshot(spark, path, "x") is None
    writers.save_snapshot(spark.range(2), path, "x", "20240101_000000")
    writers.save_snapshot(spark.range(5), path, "x", "20240301_000000")
    assert readers.latest_snapshot(spark, path, "x").count() == 5


def test_export_logs_has_all_fields(spark, tmp_path):
    a, b = spark.createDataFrame([("1", "x")], "t string, a string"), spark.createDataFrame([("2", "y")], "t string, b string")
    path = writers.export_logs([a, b], str(tmp_path / "logs"), "csv")
    assert rows(spark.read.csv(path, header=True)) == [("1", "x", None), ("2", None, "y")]


def test_upsert(spark):
    old = spark.createDataFrame([("A", 1, 1.0, 5.0), ("B", 1, 2.0, 6.0)], "tag_id string, date int, t double, h double")
    new = spark.createDataFrame([("A", 1, 9.0, 1), ("A", 1, None, 2), ("C", 1, 3.0, 1)], "tag_id string, date int, t double, n int")
    assert rows(joins.upsert(old, new, ["tag_id", "date"], "n")) == [("A", 1, None, 5.0), ("B", 1, 2.0, 6.0), ("C", 1, 3.0, None)]


def test_stored_upsert_rewrites_only_its_days(spark, tmp_path):
    path = str(tmp_path / "m")
    shape = "tag_id string, date timestamp_ntz, t double"
    storage.create_metrics(spark.createDataFrame([("A", DAY, 1.0), ("A", datetime(2024, 1, 2), 2.0)], shape), path)
    first = StoredTable(spark, path).version()
    untouched = (tmp_path / "m" / first.parts["2024-01-01"]).stat().st_mtime_ns
    batch = spark.createDataFrame([("A", datetime(2024, 1, 2), 7.0), ("B", datetime(2024, 1, 5), 8.0)], shape)
    for _ in range(2):
        storage.save_metrics(batch, path)
    assert rows(storage.read_metrics(spark, path).select("tag_id", "t")) == [("A", 1.0), ("A", 7.0), ("B", 8.0)]
    last = StoredTable(spark, path).version()
    assert last.parts["2024-01-01"] == first.parts["2024-01-01"] and last.parts["2024-01-02"] != first.parts["2024-01-02"]
    assert untouched == (tmp_path / "m" / first.parts["2024-01-01"]).stat().st_mtime_ns


def test_summary_report(spark, tmp_path):
    readings = spark.createDataFrame([("cattle", i % 5 == 0) for i in range(20)], "animal_type string, is_anomaly boolean")
    alerts = spark.createDataFrame([(2, "F2", "high", 5, DAY), (1, "F1", None, None, DAY)],
                                   "id int, farm_id string, severity string, affected_animals int, created_at timestamp_ntz")
    lines = lambda df: [r["line"] for r in df.orderBy("section", "item", "line_no").collect()]
    txt = lines(reports.summary_report(readings, alerts))
    assert "Anomaly Rate: 20.0%" in txt and "  Cattle: 4" in txt and txt[txt.index("Alert 1:") + 1] == "  Farm: F1"
    md = lines(reports.summary_report(readings, alerts, "md"))
    assert "### 🟠 Alert 2: HIGH" in md and "### ⚪ Alert 1: UNKNOWN" in md
    none = lines(reports.summary_report(readings, alerts.limit(0)))
    assert "No outbreak alerts generated." in none and "1. Continue regular monitoring" in none
    writers.write_lines(reports.summary_report(readings, alerts), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).count() == len(txt)
    with pytest.raises(ValueError):
        reports.summary_report(readings, alerts, "pdf")


def test_alerts_of_one_day_are_sorted_by_several_tasks(spark, tmp_path):
    log = spark.range(3000).select(
        F.lit(7).alias("id"), F.lit("FARM-0001").alias("farm_id"), F.lit("high").alias("severity"), F.lit("m").alias("message"),
        F.lit(1).alias("affected_animals"),
    )
    for day in ("2024-01-05 00:00:00", "2024-01-06 00:00:00"):
        writers.log_alerts(log if day.startswith("2024-01-06") else log.limit(5), str(tmp_path), day)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        out = readers.recent_alerts(spark, str(tmp_path), "2024-01-06 12:00:00", 7)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        days = [str(r["day"]) for r in out.collect()]
    finally:
        spark.conf.set(key, before)
    assert len(days) == 3005 and days == sorted(days, reverse=True)
    assert max(sizes) < 2500
