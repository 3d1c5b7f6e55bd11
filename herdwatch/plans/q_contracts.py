"""Queries: dataset contracts, rules and table constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts as ct
from ..operators import rules as ru
from . import views as v
from .registry import query, rounded, time_text

HERD = ct.DAILY_HEALTH_METRICS
AS_OF = "2001-11-06 00:00:00"


def _below(c: str, low) -> tuple[str, str, str]:
    return (f"{c} < {low}", "error", f"'Column ''{c}'' value ' || CAST({c} AS VARCHAR) || ' below minimum {low}'")


def _above(c: str, high) -> tuple[str, str, str]:
    return (f"{c} > {high}", "error", f"'Column ''{c}'' value ' || CAST({c} AS VARCHAR) || ' above maximum {high}'")


def _null(c: str) -> tuple[str, str, str]:
    return (f"{c} IS NULL", "error", f"'Column ''{c}'' cannot be null'")


def _percent(c: str) -> tuple[str, str, str]:
    return (f"{c} NOT BETWEEN 0 AND 100", "error",
            f"'Column ''{c}'' must be between 0 and 100, got ' || CAST({c} AS VARCHAR)")


def _warm(c: str) -> tuple[str, str, str]:
    return (f"{c} NOT BETWEEN -50 AND 50", "warning",
            f"'Column ''{c}'' temperature unrealistic: ' || CAST({c} AS VARCHAR) || '°C'")


def _words(c: str, *words: str) -> tuple[str, str, str]:
    return (f"{c} NOT IN ({', '.join(repr(w) for w in words)})", "error",
            f"'Column ''{c}'' value ' || {c} || ' not in allowed values'")


def _matches(c: str, pattern: str) -> tuple[str, str, str]:
    return (f"NOT regexp_matches({c}, '{pattern}')", "error", f"'Column ''{c}'' value doesn''t match pattern'")


HERD_CHECKS = {
    "farm_id": [_null("farm_id"), _matches("farm_id", r"^FARM-\d{4}$")],
    "date": [_null("date")],
    "animal_type": [_null("animal_type"), _words("animal_type", "cattle", "swine", "poultry", "sheep", "goat")],
    "total_animals": [_null("total_animals"), _below("total_animals", 0), _above("total_animals", 10000)],
    "sick_animals": [_null("sick_animals"), _below("sick_animals", 0)],
    "deceased_animals": [_null("deceased_animals"), _below("deceased_animals", 0)],
    "avg_temperature": [_null("avg_temperature"), _warm("avg_temperature"), _below("avg_temperature", 35),
                        _above("avg_temperature", 45)],
    "feed_intake_percent": [_null("feed_intake_percent"), _percent("feed_intake_percent")],
    "activity_level": [_null("activity_level"), _below("activity_level", 0), _above("activity_level", 10)],
}


def severity_of(checks) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{s}'" for c, s, _ in checks) + " ELSE 'info' END"


def message_of(checks) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {m}" for c, _, m in checks) + " END"


def has_error(checks: dict) -> str:
    return " OR ".join(f"{severity_of(c)} = 'error'" for c in checks.values())


def stats_sql(contract: ct.Contract, checks: dict, source: str) -> str:
    rows = []
    for rule in contract.columns:
        c = rule.name
        extra = f" + count(*) FILTER ({c} IS NULL)" if c in contract.required else ""
        if c in checks:
            rows.append(
                f"""SELECT '{c}' AS "column", '{rule.kind}' AS data_type, true AS required, true AS present,
count(*) FILTER ({c} IS NULL) AS null_count,
count(*) FILTER ({severity_of(checks[c])} = 'error'){extra} AS error_count,
count(*) FILTER ({severity_of(checks[c])} = 'warning') AS warning_count FROM {source}"""
            )
        else:
            rows.append(f"SELECT '{c}', '{rule.kind}', true, false, 0, 1, 0")
    return " UNION ALL ".join(rows)


@query(
    v.with_views(
        "herd_daily",
        " UNION ALL ".join(
            f"""SELECT farm_id, {time_text("date")} AS date, animal_type, '{c}' AS "column",
{severity_of(checks)} AS severity, {message_of(checks)} AS message FROM herd_daily
WHERE {severity_of(checks)} <> 'info'"""
            for c, checks in HERD_CHECKS.items()
        ),
    )
)
def contract_issue_rows(spark, sf_dir):
    return ct.issue_rows(v.herd_daily(spark, sf_dir), HERD, keep=["farm_id", "date", "animal_type"])


@query(v.with_views("herd_daily", stats_sql(HERD, HERD_CHECKS, "herd_daily")))
def contract_issue_counts(spark, sf_dir):
    return ct.column_stats(v.herd_daily(spark, sf_dir), HERD)


ERRORS = " + ".join(f"count(*) FILTER ({severity_of(c)} = 'error')" for c in HERD_CHECKS.values())
WARNINGS = " + ".join(f"count(*) FILTER ({severity_of(c)} = 'warning')" for c in HERD_CHECKS.values())
INFOS = " + ".join(f"count(*) FILTER ({severity_of(c)} = 'info')" for c in HERD_CHECKS.values())
BAD = has_error(HERD_CHECKS)


@query(
    v.with_views(
        "herd_daily",
        f"""SELECT 'daily_health_metrics' AS contract, '1.0' AS version, count(*) AS total_rows, 12 AS columns_checked,
       3 + {ERRORS} AS errors, {WARNINGS} + CASE WHEN count(*) > 1000 THEN 1 ELSE 0 END AS warnings, {INFOS} AS infos,
       count(*) FILTER (NOT ({BAD})) AS valid_rows, count(*) FILTER ({BAD}) AS invalid_rows,
       'water_intake_percent,location_lat,location_lon' AS missing_columns, '' AS extra_columns,
       CASE WHEN count(*) > 1000 THEN count(*) || ' rows, expected at most 1000' END AS row_count_issue,
       false AS is_valid
FROM herd_daily""",
    )
)
def contract_summary(spark, sf_dir):
    return ct.summary(v.herd_daily(spark, sf_dir), HERD)


SICK = "sick_animals > total_animals"
DEAD = "deceased_animals > sick_animals"
ACTIVE = "sick_animals * 100e0 / total_animals > 20 AND activity_level > 7"


def _rule(name: str, severity: str, condition: str, text: str) -> str:
    n = f"count(*) FILTER ({condition})"
    return f"""SELECT '{name}' AS rule, {n} = 0 AS passed, '{severity}' AS severity, {n} AS violations,
CASE WHEN {n} > 0 THEN '{text} in ' || {n} || ' rows' ELSE 'passed' END AS message FROM herd_daily"""


REPEATED = """(SELECT coalesce(sum(n), 0)::BIGINT FROM (
  SELECT count(*) AS n FROM herd_daily GROUP BY farm_id, date, animal_type HAVING count(*) > 1))"""


@query(
    v.with_views(
        "herd_daily",
        " UNION ALL ".join(
            [
                _rule("sick_animals_not_exceed_total", "error", SICK, "Sick animals exceed total animals"),
                _rule("deceased_not_exceed_sick", "error", DEAD, "Deceased animals exceed sick animals"),
                _rule("activity_sickness_correlation", "warning", ACTIVE, "High sickness with normal activity"),
                f"""SELECT 'duplicate_primary_key', {REPEATED} = 0, 'error', {REPEATED},
CASE WHEN {REPEATED} > 0 THEN 'Found ' || {REPEATED} || ' duplicate rows based on primary key'
ELSE 'No duplicate primary keys found' END""",
            ]
        ),
    )
)
def contract_rules(spark, sf_dir):
    return ru.rule_results(v.herd_daily(spark, sf_dir), ru.DEFAULT_RULES, HERD.primary_key)


@query(v.with_views("herd_daily", f"SELECT {REPEATED} AS duplicate_rows"))
def contract_pk_duplicates(spark, sf_dir):
    return ru.duplicates(v.herd_daily(spark, sf_dir), HERD.primary_key).select("duplicate_rows")


COMPLETE = "(" + " + ".join(f"count({c})" for c in HERD_CHECKS) + ") * 1e0 / (9 * count(*))"
REPORT = f"""report AS (
  SELECT count(*) AS rows, {COMPLETE} AS completeness,
         count(*) FILTER (NOT ({BAD})) * 1e0 / count(*) AS accuracy,
         greatest(0, 1 - CASE WHEN bool_or({SICK}) THEN 0.2e0 ELSE 0 END
                       - CASE WHEN bool_or({DEAD}) THEN 0.2e0 ELSE 0 END) AS consistency,
         CASE WHEN datesub('day', max(date), TIMESTAMP '{AS_OF}') <= 1 THEN 1e0
              WHEN datesub('day', max(date), TIMESTAMP '{AS_OF}') <= 3 THEN 0.8e0
              WHEN datesub('day', max(date), TIMESTAMP '{AS_OF}') <= 7 THEN 0.5e0 ELSE 0.2e0 END AS timeliness,
         0e0 AS validity, 3 + {ERRORS} AS schema_errors,
         CASE WHEN bool_or({SICK}) THEN 1 ELSE 0 END + CASE WHEN bool_or({DEAD}) THEN 1 ELSE 0 END
           + CASE WHEN {REPEATED} > 0 THEN 1 ELSE 0 END AS rule_errors
  FROM herd_daily),
scored AS (SELECT *, 0.3e0 * completeness + 0.3e0 * accuracy + 0.2e0 * consistency + 0.1e0 * timeliness
                     + 0.1e0 * validity AS s FROM report)"""


@query(
    v.with_views(
        "herd_daily",
        f"""WITH {REPORT}
SELECT rows, {rounded("completeness")} AS completeness, {rounded("accuracy")} AS accuracy,
       {rounded("consistency")} AS consistency, {rounded("timeliness")} AS timeliness,
       {rounded("validity")} AS validity, schema_errors, rule_errors, round(s, 3) AS quality_score,
       CASE WHEN s >= 0.9 THEN 'A' WHEN s >= 0.8 THEN 'B' WHEN s >= 0.7 THEN 'C' WHEN s >= 0.6 THEN 'D' ELSE 'F' END
         AS grade, 9 AS columns FROM scored""",
    )
)
def contract_quality_score(spark, sf_dir):
    return ru.quality_report(v.herd_daily(spark, sf_dir), HERD, AS_OF)


@query(
    v.with_views(
        "herd_daily",
        f"""WITH {REPORT}
SELECT {rounded("completeness")} AS completeness, {rounded("accuracy")} AS accuracy,
       {rounded("round(s, 3)")} AS quality_score,
       completeness >= 0.8 AND accuracy >= 0.9 AND round(s, 3) >= 0.7 AS passes FROM scored""",
    )
)
def contract_quality_gate(spark, sf_dir):
    return ru.passes_gate(ru.quality_report(v.herd_daily(spark, sf_dir), HERD, AS_OF))


@query(
    v.with_views(
        "herd_daily",
        f"""WITH {REPORT}, stats AS ({stats_sql(HERD, HERD_CHECKS, "herd_daily")})
SELECT 'schema_error' AS type, NULL AS "column", schema_errors AS count,
       'Data does not conform to expected schema' AS description FROM report WHERE schema_errors > 0
UNION ALL SELECT 'business_rule_error', NULL, rule_errors, 'Data violates business rules' FROM report
  WHERE rule_errors > 0
UNION ALL SELECT 'column_error', "column", error_count, 'Column ''' || "column" || ''' has validation errors'
  FROM stats WHERE error_count > 0""",
    )
)
def contract_major_issues(spark, sf_dir):
    return ru.major_issues(ru.validate(v.herd_daily(spark, sf_dir), HERD))


@query(
    v.with_views(
        "herd_daily",
        f"""WITH {REPORT}
SELECT 'Increase data completeness by reducing null values' AS recommendation FROM report WHERE completeness < 0.9
UNION ALL SELECT 'Improve data accuracy by fixing validation errors' FROM report WHERE accuracy < 0.9
UNION ALL SELECT 'Fix schema validation errors before processing' FROM report WHERE schema_errors > 0
UNION ALL SELECT 'Review and fix business rule violations' FROM report WHERE rule_errors > 0""",
    )
)
def contract_advice(spark, sf_dir):
    return ru.advice(ru.quality_report(v.herd_daily(spark, sf_dir), HERD, AS_OF))


@query(
    v.with_views(
        "herd_daily",
        f"""SELECT count(*) AS total_records, count(*) FILTER (NOT ({BAD})) AS valid_records,
       count(*) FILTER ({BAD}) AS invalid_records,
       {rounded(f"count(*) FILTER (NOT ({BAD})) * 1e0 / count(*)")} AS validation_rate, NULL AS message
FROM herd_daily""",
    )
)
def contract_batch_rate(spark, sf_dir):
    return ru.batch_summary(v.herd_daily(spark, sf_dir), HERD)


# Alerts and environment readings under their contracts.
ALERT_ROWS = """rows AS (
  SELECT 'ALERT-' || strftime(created_at, '%Y%m%d') || '-'
           || CASE WHEN length(CAST(id AS VARCHAR)) < 6 THEN lpad(CAST(id AS VARCHAR), 6, '0')
                   ELSE CAST(id AS VARCHAR) END AS alert_id,
         created_at AS timestamp, farm_id, severity, affected_animals / 10e0 AS anomaly_score,
         affected_animals AS sick_count, CASE WHEN NOT is_resolved THEN message END AS description,
         CASE WHEN is_resolved THEN 'resolved' WHEN severity = 'low' THEN 'closed' ELSE 'new' END AS status FROM alerts)"""
ALERT_CHECKS = {
    "alert_id": [_null("alert_id"), _matches("alert_id", r"^ALERT-\d{8}-\d{6}$")],
    "timestamp": [_null("timestamp")],
    "farm_id": [_null("farm_id")],
    "severity": [_null("severity"), _words("severity", "low", "medium", "high", "critical")],
    "anomaly_score": [_null("anomaly_score"), _below("anomaly_score", 0), _above("anomaly_score", 1)],
    "sick_count": [_null("sick_count"), _below("sick_count", 0)],
    "description": [("description IS NULL", "info", "''")],
    "status": [_null("status"), _words("status", "new", "investigating", "confirmed", "false_positive", "resolved")],
}


def alert_rows(spark, sf_dir):
    number = F.col("id").cast("string")
    return v.alerts(spark, sf_dir).select(
        F.concat(
            F.lit("ALERT-"), F.date_format("created_at", "yyyyMMdd"), F.lit("-"),
            F.when(F.length(number) < 6, F.lpad(number, 6, "0")).otherwise(number),
        ).alias("alert_id"),
        F.col("created_at").alias("timestamp"), "farm_id", "severity",
        (F.col("affected_animals") / 10).alias("anomaly_score"), F.col("affected_animals").alias("sick_count"),
        F.when(~F.col("is_resolved"), F.col("message")).alias("description"),
        F.when(F.col("is_resolved"), "resolved").when(F.col("severity") == "low", "closed").otherwise("new")
        .alias("status"),
    )


@query(v.with_views("alerts", f"WITH {ALERT_ROWS} {stats_sql(ct.OUTBREAK_ALERTS, ALERT_CHECKS, 'rows')}"))
def contract_alerts(spark, sf_dir):
    return ct.column_stats(alert_rows(spark, sf_dir), ct.OUTBREAK_ALERTS)


ENV_ROWS = """rows AS (
  SELECT 'LOC-' || user_id AS location_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, value - 20 AS temperature,
         CASE WHEN event_type <> 'error' THEN CAST(value * 2 AS VARCHAR) ELSE 'n/a' END AS humidity,
         value * 10 AS air_quality_index, value - 1 AS precipitation_mm, value AS wind_speed FROM events)"""
ENV_CHECKS = {
    "location_id": [_null("location_id")],
    "timestamp": [_null("timestamp")],
    "temperature": [_null("temperature"), _warm("temperature"), _below("temperature", -30), _above("temperature", 50)],
    "humidity": [_null("humidity"), ("TRY_CAST(humidity AS DOUBLE) IS NULL", "error", "''"),
                 ("TRY_CAST(humidity AS DOUBLE) NOT BETWEEN 0 AND 100", "error", "''")],
    "air_quality_index": [_null("air_quality_index"), _below("air_quality_index", 0), _above("air_quality_index", 500)],
    "precipitation_mm": [_null("precipitation_mm"), _below("precipitation_mm", 0)],
    "wind_speed": [_null("wind_speed"), _below("wind_speed", 0), _above("wind_speed", 200)],
}


def environment_rows(spark, sf_dir):
    value = F.col("value")
    return v.table(spark, sf_dir, "events").select(
        F.concat(F.lit("LOC-"), F.col("user_id").cast("string")).alias("location_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        (value - 20).alias("temperature"),
        F.when(F.col("event_type") != "error", (value * 2).cast("string")).otherwise("n/a").alias("humidity"),
        (value * 10).alias("air_quality_index"), (value - 1).alias("precipitation_mm"), value.alias("wind_speed"),
    )


@query(f"WITH {ENV_ROWS} {stats_sql(ct.ENVIRONMENTAL_DATA, ENV_CHECKS, 'rows')}")
def contract_environment(spark, sf_dir):
    return ct.column_stats(environment_rows(spark, sf_dir), ct.ENVIRONMENTAL_DATA)


def _constraint(name: str, condition: str) -> str:
    return f"SELECT '{name}' AS \"constraint\", count(*) FILTER ({condition}) AS violations FROM typed"


@query(
    v.with_views(
        "herd_daily",
        """WITH typed AS (SELECT * REPLACE (TRY_CAST(avg_temperature AS DECIMAL(4,1)) AS avg_temperature,
  TRY_CAST(feed_intake_percent AS DECIMAL(5,2)) AS feed_intake_percent,
  TRY_CAST(activity_level AS DECIMAL(3,1)) AS activity_level) FROM herd_daily) """
        + " UNION ALL ".join(
            [_constraint(f"not_null({c})", f"{c} IS NULL")
             for c in ("farm_id", "date", "animal_type", "total_animals", "sick_animals", "deceased_animals")]
            + [
                _constraint("check(total_animals)", "NOT (total_animals >= 0)"),
                _constraint("check(sick_animals)", "NOT (sick_animals >= 0 AND sick_animals <= total_animals)"),
                _constraint("check(deceased_animals)",
                            "NOT (deceased_animals >= 0 AND deceased_animals <= sick_animals)"),
                _constraint("check(avg_temperature)", "NOT (avg_temperature BETWEEN 35 AND 45)"),
                _constraint("check(feed_intake_percent)", "NOT (feed_intake_percent BETWEEN 0 AND 100)"),
                _constraint("check(activity_level)", "NOT (activity_level BETWEEN 0 AND 10)"),
                f"SELECT 'unique(farm_id,date,animal_type)', {REPEATED}",
            ]
        ),
    )
)
def table_constraints(spark, sf_dir):
    return ru.constraint_violations(v.herd_daily(spark, sf_dir), "livestock_health_metrics")
