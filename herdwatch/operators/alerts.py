"""Alerts: search, thresholds, statistics, message texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ALERT_ACTIONS, SEVERITY_RANK
from ..functions.scalars import moment, ranked
from .filters import newest_first, recent


def search(
    alerts: DataFrame, keyword: str | None = None, severity: str | None = None, farm_id: str | None = None,
    as_of=None, days: int | None = None, date: str = "created_at",
) -> DataFrame:
    """Case-insensitive match on severity and farm; keyword anywhere in message or description."""
    out = recent(alerts, as_of, days, date)
    if severity:
        out = out.filter(F.lower(F.coalesce("severity", F.lit(""))) == severity.lower())
    if farm_id:
        out = out.filter(F.lower(F.coalesce("farm_id", F.lit(""))) == farm_id.lower())
    if keyword:
        found = F.lit(False)
        for column in ("message", "description"):
            if column in alerts.columns:
                found = found | F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(keyword.lower()))
        out = out.filter(found)
    return out


def over_threshold(alerts: DataFrame, threshold: str = "high") -> DataFrame:
    """Alerts whose severity reaches the threshold; unknown severities rank lowest."""
    level = ranked(F.lower(F.coalesce("severity", F.lit("low"))), SEVERITY_RANK)
    return alerts.filter(level >= SEVERITY_RANK.get(threshold.lower(), 0))


def history(
    alerts: DataFrame, limit: int = 20, severity: str | None = None, date: str = "created_at", tie: str = "id"
) -> DataFrame:
    """The newest alerts, optionally of one severity."""
    out = search(alerts, severity=severity) if severity else alerts
    return newest_first(out, date, tie, limit)


def stats(alerts: DataFrame, as_of=None, days: int | None = None, date: str = "created_at") -> DataFrame:
    """Total and counts by severity, farm and day, in one pass: (section, key, alerts)."""
    keyed = recent(alerts, as_of, days, date).select(
        F.coalesce("severity", F.lit("unknown")).alias("severity"),
        F.coalesce(F.col("farm_id").cast("string"), F.lit("unknown")).alias("farm"),
        F.date_format(date, "yyyy-MM-dd").alias("day"),
    )
    names = ("severity", "farm", "day")
    sets = [[F.col(n)] for n in names] + [[]]
    counted = keyed.groupingSets(sets, *names).agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("alerts")
    )
    section = {3: ("by_severity", "severity"), 5: ("by_farm", "farm"), 6: ("daily_count", "day")}
    name, key = F.lit("total_alerts"), F.lit("all")
    for bits, (label, column) in section.items():
        name = F.when(F.col("_g") == bits, label).otherwise(name)
        key = F.when(F.col("_g") == bits, F.col(column)).otherwise(key)
    return counted.select(name.alias("section"), key.alias("key"), "alerts").filter(F.col("key").isNotNull())


def resolve(alerts: DataFrame, alert_id, as_of) -> DataFrame:
    """Mark one alert resolved and stamp its end date."""
    hit = F.col("id") == alert_id
    end = F.col("end_date") if "end_date" in alerts.columns else F.lit(None).cast("timestamp_ntz")
    return alerts.withColumns(
        {
            "is_resolved": F.when(hit, F.lit(True)).otherwise(F.col("is_resolved")),
            "end_date": F.when(hit, moment(as_of)).otherwise(end),
        }
    )


def with_defaults(alerts: DataFrame, as_of) -> DataFrame:
    """Fill what an alert must have: timestamp, severity; add the log line and the day."""
    present = alerts.columns

    def value(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in present else default

    stamp = value("timestamp", moment(as_of))
    line = F.format_string(
        "[%s] [%s] Farm: %s | Animals: %s | %s",
        F.date_format(moment(as_of), "yyyy-MM-dd HH:mm:ss"),
        F.upper(value("severity", F.lit("info"))),
        value("farm_id", F.lit("UNKNOWN")),
        value("affected_animals", F.lit(0)).cast("string"),
        value("message", F.lit("No message")),
    )
    return alerts.withColumns(
        {
            "line": line,
            "timestamp": stamp,
            "severity": value("severity", F.lit("info")),
            "day": F.date_format(moment(as_of), "yyyy-MM-dd"),
        }
    )


def subject(title: str = "Herd Outbreak Alert") -> Column:
    """One subject line per alert."""
    return F.format_string(
        f"[%s] {title} - Farm %s - %s Animals Affected",
        F.upper(F.coalesce("severity", F.lit("ALERT"))),
        F.coalesce(F.col("farm_id").cast("string"), F.lit("Unknown Farm")),
        F.coalesce(F.col("affected_animals"), F.lit(0)).cast("string"),
    )


def body(alerts: DataFrame, as_of, title: str = "HERD OUTBREAK ALERT") -> Column:
    """The message text of an alert, with the actions for its severity; missing parts are left out."""
    have = set(alerts.columns)

    def part(name: str, text: Column) -> list[Column]:
        return [F.when(F.col(name).isNotNull(), text)] if name in have else []

    def joined(name: str) -> Column:
        return F.concat_ws(", ", F.col(name))

    severity = F.coalesce("severity", F.lit("medium"))
    actions = None
    for name, texts in ALERT_ACTIONS.items():
        text = F.lit("\n".join(f"{i}. {t}" for i, t in enumerate(texts, 1)))
        if name == "low":
            actions = actions.otherwise(text)
        else:
            hit = F.lower(severity) == name
            actions = F.when(hit, text) if actions is None else actions.when(hit, text)
    stamp = "yyyy-MM-dd HH:mm:ss"
    return F.concat_ws(
        "\n",
        F.lit(title),
        F.lit("=" * 50),
        F.lit(""),
        F.concat(F.lit("ALERT SEVERITY: "), F.upper(F.coalesce("severity", F.lit("UNKNOWN")))),
        F.concat(F.lit("FARM ID: "), F.coalesce(F.col("farm_id").cast("string"), F.lit("Unknown"))),
        F.concat(F.lit("DETECTION TIME: "), F.date_format(moment(as_of), stamp)),
        *part("created_at", F.concat(F.lit("ALERT GENERATED: "), F.date_format("created_at", stamp))),
        F.lit(""),
        F.lit("OUTBREAK DETAILS:"),
        F.lit("-" * 20),
        F.concat(F.lit("Affected Animals: "), F.coalesce(F.col("affected_animals"), F.lit(0)).cast("string")),
        *part("start_date", F.concat(F.lit("Start Date: "), F.date_format("start_date", "yyyy-MM-dd"))),
        *part("end_date", F.concat(F.lit("End Date: "), F.date_format("end_date", "yyyy-MM-dd"))),
        *part("animal_types", F.concat(F.lit("Animal Types: "), joined("animal_types"))),
        *part("detection_methods", F.concat(F.lit("Detection Methods: "), joined("detection_methods"))),
        *part("avg_anomaly_score", F.format_string("Average Anomaly Score: %.2f", "avg_anomaly_score")),
        *part("ensemble_score", F.format_string("Ensemble Confidence Score: %.2f/10.0", "ensemble_score")),
        *part("features_contributing", F.concat(F.lit("Key Metrics Affected: "), joined("features_contributing"))),
        *part("description", F.concat(F.lit("\nDescription: "), F.col("description"))),
        F.lit("\nRECOMMENDED ACTIONS:"),
        F.lit("-" * 20),
        actions,
    )


def short_message() -> Column:
    """The short text shown for an alert."""
    return F.format_string(
        "[%s ALERT] Farm: %s\nAffected Animals: %s\nDescription: %s\n",
        F.upper(F.coalesce("severity", F.lit("unknown"))),
        F.coalesce(F.col("farm_id").cast("string"), F.lit("Unknown Farm")),
        F.coalesce(F.col("affected_animals"), F.lit(0)).cast("string"),
        F.coalesce("description", F.lit("")),
    )
