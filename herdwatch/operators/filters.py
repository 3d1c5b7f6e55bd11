"""Listings and extracts of readings and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import days_before


def recent(df: DataFrame, as_of, days: int | None, date: str = "date") -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``; the bound reaches the file scan."""
    return df if days is None else df.filter(F.col(date) >= days_before(as_of, days))


def newest_first(df: DataFrame, date: str, tie: str, limit: int | None = None) -> DataFrame:
    out = df.orderBy(F.col(date).desc(), F.col(tie).desc())
    return out if limit is None else out.limit(limit)


def recent_metrics(
    readings: DataFrame, as_of, days: int = 30, farm_id=None, animal_type: str | None = None,
    tie: str = "arrival_id",
) -> DataFrame:
    """Readings of the last days, optionally of one farm or animal type, newest first."""
    out = recent(readings, as_of, days)
    if farm_id is not None:
        out = out.filter(F.col("farm_id") == farm_id)
    if animal_type is not None:
        out = out.filter(F.col("animal_type") == animal_type)
    return newest_first(out, "date", tie)


def latest_metrics(
    readings: DataFrame, as_of, columns: Sequence[str], days: int = 30, limit: int = 1000, tie: str = "arrival_id"
) -> DataFrame:
    """The newest readings of the last days, a fixed number of them."""
    return newest_first(recent(readings, as_of, days).select(*columns, tie), "date", tie, limit)


def active_alerts(alerts: DataFrame, severity: str | None = None, limit: int | None = None) -> DataFrame:
    """Unresolved alerts, newest first."""
    out = alerts.filter(~F.col("is_resolved"))
    if severity is not None:
        out = out.filter(F.col("severity") == severity)
    return newest_first(out, "created_at", "id", limit)


def anomalies(readings: DataFrame, as_of=None, days: int | None = None, tie: str = "arrival_id") -> DataFrame:
    """Flagged readings, newest first."""
    return newest_first(recent(readings.filter("is_anomaly"), as_of, days), "date", tie)


def alerts_between(alerts: DataFrame, as_of=None, days: int | None = None) -> DataFrame:
    """All alerts, or those of the last days, newest first."""
    return newest_first(recent(alerts, as_of, days, "created_at"), "created_at", "id")


def animal_timeline(readings: DataFrame, tag_id, metrics: Sequence[str]) -> DataFrame:
    """One animal's readings in long form: date, metric, value, flag. Raises when there are none."""
    mine = readings if tag_id is None else readings.filter(F.col("tag_id") == tag_id)
    if mine.isEmpty():
        raise ValueError("no data for this animal")
    return timeline_long(mine, metrics)


def timeline_long(readings: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Readings in long form: tag_id, date, metric, value, is_anomaly."""
    rows = [
        F.struct(
            F.lit(m).alias("metric"),
            F.col(m).alias("value"),
            (F.col(f"{m}_anomaly") if f"{m}_anomaly" in readings.columns else F.lit(False)).alias("is_anomaly"),
        )
        for m in metrics
        if m in readings.columns
    ]
    return (
        readings.select("tag_id", "date", F.explode(F.array(*rows)).alias("_r"))
        .select("tag_id", "date", "_r.*")
        .filter(F.col("value").isNotNull())
    )
