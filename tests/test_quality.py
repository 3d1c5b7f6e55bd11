from datetime import datetime, timedelta

import pytest
from conftest import rows

from herdwatch.operators import quality

START = datetime(2024, 1, 1)
SHAPE = "tag_id string, date timestamp_ntz, animal_type string, temperature double, heart_rate double, activity_level double"


@pytest.fixture(scope="module")
def bad(spark):
    out = []
    for i in range(100):
        out.append((
            f"A{i % 20}", None if i < 5 else START + timedelta(days=i // 20), ["cattle", "sheep", "goat", "unknown"][i % 4],
            None if 10 <= i < 20 else (45.0 if i < 5 else (30.0 if i < 10 else 38.5)),
            None if i < 25 else (150.0 if i < 30 else 70.0),
            None if i < 35 else (0.05 if i < 40 else 1.0),
        ))
    return spark.createDataFrame(out + out[50:55], SHAPE)


def test_completeness_and_validity(bad):
    c = {r["column"]: r for r in quality.completeness(bad).collect()}
    assert c["date"]["missing_count"] == 5 and c["date"]["critical"] and not c["heart_rate"]["critical"]
    missing = 5 + 10 + 25 + 35
    assert c["*"]["missing_count"] == missing and c["*"]["complete_pct"] == pytest.approx(100 - missing / 630 * 100)
    v = {r["column"]: r for r in quality.validity(bad).collect()}
    assert (v["temperature"]["invalid_count"], v["heart_rate"]["invalid_count"], v["activity_level"]["invalid_count"]) == (20, 30, 40)
    assert v["animal_type"]["invalid_count"] is None and v["animal_type"]["valid_pct"] == 100


def test_duplicates_count_all_copies_and_equal_nulls(bad, spark):
    d = quality.duplicates(bad).first()
    assert d["duplicate_rows"] == 10 and d["score"] == pytest.approx(100 - 2 * 10 / 105 * 100)
    nulls = spark.createDataFrame([("A", None), ("A", None), ("B", None)], "tag_id string, date timestamp_ntz")
    assert quality.duplicates(nulls).first()["duplicate_rows"] == 2


def test_type_conflicts_and_disorder(spark):
    df = spark.createDataFrame(
        [("A", 0, START, "cattle"), ("A", 1, START - timedelta(days=1), "sheep"), ("B", 2, START, "goat"),
         ("B", 3, None, "goat"), ("C", 4, None, "goat"), ("D", 5, START, "x"), ("D", 6, START, "x")],
        "tag_id string, arrival_id long, date timestamp_ntz, animal_type string")
    assert rows(quality.type_conflicts(df)) == [("A", 2)]
    assert [r[0] for r in rows(quality.date_disorder(df))] == ["A", "B"]


def test_frequency_and_timeliness(spark):
    df = spark.createDataFrame(
        [("A", START), ("A", START + timedelta(days=4)), ("A", START + timedelta(days=6)), ("B", START),
         ("B", START + timedelta(days=1)), ("C", START)], "tag_id string, date timestamp_ntz")
    f = quality.update_frequency(df).first()
    assert (f["mean_days_between"], f["median_days_between"], f["consistent"]) == (2.0, 2.0, True)
    t = quality.timeliness(df, "2024-01-20 00:00:00").first()
    assert (t["days_old"], t["recency_score"], t["frequency_score"], t["timeliness"]) == (13, 70.0, 80.0, 73.0)
    one = quality.timeliness(df.filter("tag_id = 'C'"), "2024-06-01 00:00:00").first()
    assert (one["recency_score"], one["frequency_score"]) == (10.0, 50.0)


def test_issues_and_recommendations(bad):
    m = quality.measures(bad, "2024-06-01 00:00:00")
    found = {r["type"]: r["severity"] for r in quality.issues(m).collect()}
    assert found == {"completeness": "medium", "validity": "medium", "duplicates": "medium", "stale_data": "high"}
    assert quality.issues_of(quality.issues(m), "HIGH").count() == 1
    recs = quality.recommendations(m).collect()
    assert recs[0]["priority"] == "high" and {r["issue"] for r in recs} == set(found) | {"general"}
    critical = quality.measures(bad.withColumn("animal_type", bad["animal_type"].cast("string")).replace("cattle", None, ["animal_type"]), "2024-01-06 00:00:00")
    assert [r["column"] for r in quality.issues(critical).collect() if r["type"] == "missing_critical_column"] == ["animal_type"]


def test_empty_table(spark):
    m = quality.measures(spark.createDataFrame([], SHAPE), "2024-06-01 00:00:00")
    s = quality.score(m).first()
    assert [s[c] for c in ("completeness", "validity", "consistency", "timeliness", "quality_score", "level")] == [0, 0, 0, 0, 0, 1]
    assert [r["message"] for r in quality.issues(m).collect()] == ["No data available for analysis"]
    assert [r["recommendation"] for r in quality.recommendations(m).collect()] == ["Collect more data"]


def test_good_data_scores_high(spark):
    out = [(f"A{i % 10}", START + timedelta(days=i // 10), "cattle", 38.5, 70.0, 1.0) for i in range(50)]
    tables = quality.analyze(spark.createDataFrame(out, SHAPE), "2024-01-06 00:00:00")
    assert tables["score"].first()["quality_score"] == 100 and tables["score"].first()["rating"] == "Excellent"
    assert tables["issues"].count() == 0
    b = tables["basic_stats"].first()
    assert (b["total_records"], b["unique_animals"], b["days"], b["records_median"]) == (50, 10, 5, 5.0)
    text = [r["line"] for r in quality.text_report(tables["measures"]).orderBy("section", "item").collect()]
    assert text[1] == "★★★★★ EXCELLENT" and text[4].startswith("Completeness: ")


def test_quick_check_ignores_nulls(bad):
    got = {(r["check"], r["column"]): r["count"] for r in quality.quick_check(bad, "2024-01-31 00:00:00").collect()}
    assert got[("out_of_range", "temperature")] == 10 and got[("missing", "heart_rate")] == 25
    assert got[("days_old", "date")] == 26
