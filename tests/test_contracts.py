import pytest
from conftest import rows
from pyspark.sql import functions as F

from herdwatch.operators import contracts as ct
from herdwatch.operators import rules as ru

PEOPLE = ct.Contract(
    "people",
    (ct.ColumnRule("id", "integer", min_value=1), ct.ColumnRule("name", "string"),
     ct.ColumnRule("score", "float", nullable=True, min_value=0, max_value=100)),
    required=("id", "name"), primary_key=("id",), row_count=(1, 3),
)


def verdict(spark, rule, value, kind):
    df = spark.createDataFrame([(value,)], f"{rule.name} {kind}")
    got = df.select(ct.verdict(rule, kind).alias("v"), ct.severity_code(rule, kind).alias("c")).first()
    assert {"info": 0, "warning": 1, "error": 2}[got["v"]["severity"]] == got["c"]
    return got["v"]["severity"], got["v"]["message"]


@pytest.mark.parametrize(
    ("rule", "value", "kind", "severity"),
    [
        (ct.ColumnRule("a", "integer", min_value=0, max_value=100), 25, "int", "info"),
        (ct.ColumnRule("a", "integer", min_value=0, max_value=100), "25", "string", "info"),
        (ct.ColumnRule("a", "integer", min_value=0, max_value=100), 25.0, "double", "info"),
        (ct.ColumnRule("a", "integer"), 25.5, "double", "error"),
        (ct.ColumnRule("a", "integer", min_value=0), -5, "int", "error"),
        (ct.ColumnRule("a", "integer", max_value=100), 150, "int", "error"),
        (ct.ColumnRule("a", "integer"), "abc", "string", "error"),
        (ct.ColumnRule("a", "integer"), None, "int", "error"),
        (ct.ColumnRule("a", "integer", nullable=True), None, "int", "info"),
        (ct.ColumnRule("a", "float"), float("nan"), "double", "error"),
        (ct.ColumnRule("a", "string", pattern=r"^FARM-\d{4}$"), "FARM-1234", "string", "info"),
        (ct.ColumnRule("a", "string", pattern=r"^FARM-\d{4}$"), "farm-1234", "string", "error"),
        (ct.ColumnRule("a", "string", pattern=r"FARM"), "xFARM", "string", "error"),
        (ct.ColumnRule("a", "string", pattern=r"FARM"), "FARM-tail", "string", "info"),
        (ct.ColumnRule("a", "categorical", allowed=("cattle",)), "Cattle", "string", "error"),
        (ct.ColumnRule("a", "boolean"), "Yes", "string", "info"),
        (ct.ColumnRule("a", "boolean"), "maybe", "string", "error"),
        (ct.ColumnRule("a", "boolean"), 1, "int", "error"),
        (ct.ColumnRule("a", "datetime"), "31/12/2024", "string", "info"),
        (ct.ColumnRule("a", "datetime"), "2024-13-01", "string", "error"),
        (ct.ColumnRule("a", "datetime"), 20240101, "int", "error"),
        (ct.ColumnRule("a", "percentage"), 100.0, "double", "info"),
        (ct.ColumnRule("a", "percentage"), 100.1, "double", "error"),
        (ct.ColumnRule("a", "temperature", max_value=45), 60.0, "double", "warning"),
        (ct.ColumnRule("a", "temperature", max_value=45), 46.0, "double", "error"),
        (ct.ColumnRule("a", "weight"), -0.1, "double", "error"),
        (ct.ColumnRule("a", "count"), "many", "string", "info"),
    ],
)
def test_verdicts(spark, rule, value, kind, severity):
    assert verdict(spark, rule, value, kind)[0] == severity


def test_messages(spark):
    assert verdict(spark, ct.ColumnRule("a", "integer", min_value=0), -5, "int")[1] == "Column 'a' value -5 below minimum 0"
    assert verdict(spark, ct.ColumnRule("a", "integer", min_value=0), None, "int")[1] == "Column 'a' cannot be null"


def test_summary_counts_required_nulls_twice(spark):
    df = spark.createDataFrame([(1, "x", 5.0), (2, None, 101.0), (2, "y", None), (0, "z", 1.0)], "id int, name string, score double")
    s = ct.summary(df, PEOPLE).first()
    # row 2: name null twice and score above 100; row 4: id below 1
    assert (s["errors"], s["warnings"], s["valid_rows"], s["is_valid"]) == (4, 1, 2, False)
    assert s["row_count_issue"] == "4 rows, expected at most 3"
    stats = {r["column"]: (r["null_count"], r["error_count"]) for r in ct.column_stats(df, PEOPLE).collect()}
    assert stats == {"id": (0, 1), "name": (1, 2), "score": (1, 1)}
    listed = ct.issue_rows(df, PEOPLE, ["id"]).collect()
    assert len(listed) == 4
    full = ct.with_verdicts(df, PEOPLE).collect()
    assert [len(r["errors"]) for r in full] == [0, 3, 0, 1] and len(full[0]["infos"]) == 3


def test_missing_and_extra_columns(spark):
    df = spark.createDataFrame([(1, True)], "id int, other boolean")
    s = ct.summary(df, PEOPLE).first()
    # name: once for the dataset, once for the row; score: once for the dataset
    assert (s["errors"], s["missing_columns"], s["extra_columns"]) == (3, "name,score", "other")


def test_is_valid_never_raises(spark):
    assert ct.is_valid(spark, PEOPLE, [{"id": 1, "name": "x", "score": 2.0}])
    assert ct.is_valid(spark, PEOPLE, {"id": 1, "name": "x", "score": 2.0})
    assert not ct.is_valid(spark, PEOPLE, {"id": 0, "name": "x", "score": 2.0})
    assert not ct.is_valid(spark, PEOPLE, "nonsense")


def test_json_and_registry():
    assert ct.Contract.from_json(PEOPLE.to_json()) == PEOPLE
    ct.register(PEOPLE)
    assert ct.get("people") is PEOPLE and "daily_health_metrics" in ct.names()
    with pytest.raises(ValueError):
        ct.get("nothing")
    with pytest.raises(ValueError):
        ct.ColumnRule("a", "colour")


def test_template_has_the_declared_columns(spark):
    t = ct.template(spark, ct.DAILY_HEALTH_METRICS)
    assert t.columns == [c.name for c in ct.DAILY_HEALTH_METRICS.columns] and t.first()["avg_temperature"] == 37.5


HERD = "farm_id string, date string, animal_type string, total_animals int, sick_animals int, deceased_animals int, activity_level double"


def herd(spark, *tuples):
    return spark.createDataFrame(list(tuples), HERD)


def test_rules(spark):
    df = herd(spark, ("FARM-0001", "2024-01-01", "cattle", 100, 150, 1, 8.0), ("FARM-0001", "2024-01-01", "cattle", 0, 0, 0, 9.0),
              ("FARM-0002", "2024-01-01", "cattle", 10, None, 3, None))
    got = {r["rule"]: (r["passed"], r["severity"], r["violations"]) for r in
           ru.rule_results(df, ru.DEFAULT_RULES, ["farm_id", "date", "animal_type"]).collect()}
    assert got == {
        "sick_animals_not_exceed_total": (False, "error", 1),
        "deceased_not_exceed_sick": (True, "error", 0),
        "activity_sickness_correlation": (False, "warning", 1),
        "duplicate_primary_key": (False, "error", 2),
    }


def test_skipped_broken_and_own_rules(spark):
    df = spark.createDataFrame([(1,), (5,)], "x int")
    own = ru.Rule("x_small", lambda d: F.col("x") > 3, "%d large values", columns=("x",))
    broken = ru.Rule("broken", lambda d: F.col("nowhere") > 3, "%d")
    skipped = ru.Rule("skipped", lambda d: F.col("y") > 3, "%d", columns=("y",))
    got = {r["rule"]: r for r in ru.rule_results(df, [own, broken, skipped]).collect()}
    assert got["x_small"]["message"] == "1 large values" and not got["x_small"]["passed"]
    assert not got["broken"]["passed"] and got["broken"]["severity"] == "error"
    assert got["skipped"]["passed"] and got["skipped"]["severity"] == "info"
    ru.register_rule(own)
    assert own in ru.registered_rules()
    ru._rules.pop("x_small")


def test_validate_report_score_and_gate(spark):
    good = herd(spark, ("FARM-0001", "2024-01-01", "cattle", 100, 5, 1, 5.0)).withColumns(
        {"avg_temperature": F.lit(38.5), "feed_intake_percent": F.lit(90.0), "water_intake_percent": F.lit(90.0),
         "location_lat": F.lit(1.0), "location_lon": F.lit(1.0)})
    report = ru.validate(good, ct.DAILY_HEALTH_METRICS, ru.DEFAULT_RULES)
    assert report["overall"].first()["is_valid"]
    q = ru.quality_report(good, ct.DAILY_HEALTH_METRICS, "2024-01-02 00:00:00", report)
    assert (q.first()["quality_score"], q.first()["grade"]) == (1.0, "A")
    assert ru.passes_gate(q).first()["passes"] and ru.advice(q).count() == 0
    bad = good.drop("animal_type", "total_animals")
    report = ru.validate(bad, ct.DAILY_HEALTH_METRICS, ru.DEFAULT_RULES[:2])
    assert not report["overall"].first()["is_valid"]
    assert {r["type"] for r in ru.major_issues(report).collect()} == {"schema_error", "column_error", "business_rule_error"} - (
        set() if report["overall"].first()["rule_errors"] else {"business_rule_error"})


def test_empty_batch(spark):
    b = ru.batch_summary(herd(spark).limit(0), ct.DAILY_HEALTH_METRICS).first()
    assert (b["total_records"], b["validation_rate"], b["message"]) == (0, 0.0, "Empty batch")


def test_split_valid(spark):
    df = spark.createDataFrame([(1, "x", 5.0), (0, "y", 5.0)], "id int, name string, score double")
    good, bad = ru.split_valid(df, PEOPLE)
    assert rows(good) == [(1, "x", 5.0)] and [e["column"] for e in bad.first()["errors"]] == ["id"]


def test_constraints_let_null_pass(spark):
    df = spark.createDataFrame(
        [("A", "2024-01-01", "F", "low", 0.5, 1, "new"), ("A", "2024-01-01", None, "mild", 2.0, -1, None)],
        "alert_id string, timestamp string, farm_id string, severity string, anomaly_score double, sick_count int, status string")
    got = dict(rows(ru.constraint_violations(df, "outbreak_alerts").filter("violations > 0")))
    assert got == {"not_null(farm_id)": 1, "check(severity)": 1, "check(anomaly_score)": 1, "check(sick_count)": 1, "unique(alert_id)": 2}


def test_records_without_a_value_in_a_column(spark):
    """One record, or all of several, may lack a value; the column counts as present and null."""
    record = {"farm_id": "FARM-0001", "date": None, "activity_level": None}
    for data, n in ((record, 1), ([record, {"farm_id": None}], 2), ([{"farm_id": None}], 1)):
        df = ct.as_frame(spark, data)
        assert sorted(df.columns) == sorted({c for r in (data if n == 2 else [data] if isinstance(data, dict) else data) for c in r})
        found = ct.summary(df, ct.DAILY_HEALTH_METRICS).first()
        assert found["total_rows"] == n and found["valid_rows"] == 0
