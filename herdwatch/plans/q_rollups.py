"""Queries: stored rollups after several saves, distinct counts from bitmaps, searches by index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rollups, storage
from ..operators import search_index as si
from ..session import new_folder
from ..sources import log_source
from . import views as v
from .q_logs import AS_OF, FIELDS, RECORD
from .q_reports import ALERT_COLUMNS, FLAGGED
from .q_detection import flagged
from .registry import day_text, query, rounded, time_text


def _saves(rows, key: str):
    """Three batches of all rows: two parts, and what the first one had wrong."""
    n = F.col(key)
    return [rows.filter(n % 3 != 2), rows.filter(n % 3 == 2), rows.filter(n % 5 == 0)]


def _readings(spark, sf_dir):
    """Flagged readings in three saves, with rollup and bitmaps refreshed after each; the first save has wrong values."""
    rows = flagged(spark, sf_dir).select("arrival_id", "tag_id", "date", "farm_id", "animal_type", "is_anomaly", "anomaly_score")
    first, second, third = _saves(rows, "arrival_id")
    wrong = (F.col("arrival_id") % 5 == 0).alias("w")
    first = first.withColumns({
        "anomaly_score": F.when(wrong, F.col("anomaly_score") + 1).otherwise(F.col("anomaly_score")),
        "is_anomaly": F.col("is_anomaly") | wrong, "animal_type": F.when(wrong, "poultry").otherwise(F.col("animal_type")),
    })
    folder = new_folder(spark, "rollup")
    roll = rollups.readings_rollup(spark, f"{folder}/readings", f"{folder}/daily")
    sets = rollups.AnimalSets(spark, f"{folder}/readings", f"{folder}/numbers", f"{folder}/sets", {"animal_type": F.col("animal_type")})
    storage.create_metrics(first, f"{folder}/readings")
    for batch in (None, second, third):
        if batch is not None:
            storage.save_metrics(batch, f"{folder}/readings", keys=("arrival_id", "date"))
        roll.refresh()
        sets.refresh()
    return roll, sets


@query(
    v.with_views(
        "livestock metrics_raw",
        f"""{FLAGGED}
SELECT {day_text("date")} AS day, count(*) AS total_records, count(*) FILTER (is_anomaly) AS anomalies,
       {rounded("avg(anomaly_score)")} AS avg_score FROM enriched GROUP BY {day_text("date")}""",
    )
)
def rollup_timeline(spark, sf_dir):
    return rollups.timeline(_readings(spark, sf_dir)[0].read())


@query(
    v.with_views(
        "livestock metrics_raw",
        f"""{FLAGGED}
SELECT count(DISTINCT tag_id) AS total_animals, count(*) AS total_records,
       count(*) FILTER (is_anomaly) AS anomaly_count, count(DISTINCT farm_id) AS farms_monitored
FROM enriched WHERE date >= {AS_OF} - INTERVAL 20 DAY""",
    )
)
def rollup_summary(spark, sf_dir):
    roll, sets = _readings(spark, sf_dir)
    days = rollups.days_since(roll.table.version(), v.METRICS_AS_OF, 20)
    return rollups.summary(roll.read(days), sets.read(days))


@query(
    v.with_views(
        "livestock metrics_raw",
        f"""WITH e AS (SELECT * FROM metrics_raw LEFT JOIN livestock USING (tag_id))
SELECT animal_type, count(*) AS records,
       {rounded("count(*) * 100e0 / (SELECT count(DISTINCT tag_id) FROM e)")} AS pct_of_animals,
       {rounded("count(*) * 100e0 / (SELECT count(*) FROM e)")} AS pct_of_records
FROM e WHERE animal_type IS NOT NULL GROUP BY animal_type""",
    )
)
def rollup_types(spark, sf_dir):
    roll, sets = _readings(spark, sf_dir)
    return rollups.type_shares(roll.read(), sets.read())


@query(
    v.with_views(
        "livestock metrics_raw",
        f"""{FLAGGED},
t AS (SELECT count(DISTINCT tag_id) AS a, count(*) AS r, count(DISTINCT farm_id) AS f,
             count(*) FILTER (is_anomaly) AS n FROM enriched)
SELECT 'summary' AS section, 'total_animals' AS key, CAST(a AS VARCHAR) AS value FROM t
UNION ALL SELECT 'summary', 'total_records', CAST(r AS VARCHAR) FROM t
UNION ALL SELECT 'summary', 'farms_monitored', CAST(f AS VARCHAR) FROM t
UNION ALL SELECT 'anomalies', 'anomaly_count', CAST(n AS VARCHAR) FROM t
UNION ALL SELECT 'anomalies', 'anomaly_rate', printf('%.1f%%', n * 100e0 / r) FROM t
UNION ALL SELECT 'recommendations', 'advice', CASE
    WHEN n = 0 THEN 'All systems normal. Continue regular monitoring.'
    WHEN n <= 3 THEN 'Minor anomalies detected. Review individual animals.'
    WHEN n <= 10 THEN 'Moderate anomalies detected. Increase monitoring frequency.'
    ELSE 'Significant anomalies detected. Consider veterinary consultation.' END FROM t
UNION ALL SELECT 'animals_by_type', upper(animal_type[1]) || animal_type[2:], CAST(count(DISTINCT tag_id) AS VARCHAR)
    FROM enriched GROUP BY animal_type""",
    )
)
def rollup_daily(spark, sf_dir):
    roll, sets = _readings(spark, sf_dir)
    return rollups.daily_figures(roll.read(), sets.read())


@query(
    v.with_views(
        "livestock",
        """SELECT 'by_type' AS section, animal_type, count(*) AS animals, NULL::BIGINT AS farms
FROM livestock WHERE is_active GROUP BY animal_type
UNION ALL
SELECT 'total', NULL, count(*), count(DISTINCT farm_id) FROM livestock WHERE is_active""",
    )
)
def herd_figures(spark, sf_dir):
    return rollups.herd_figures(v.livestock(spark, sf_dir))


@query(
    v.with_views(
        "alerts",
        """SELECT 'total_alerts' AS section, 'all' AS key, count(*) AS alerts FROM alerts
UNION ALL SELECT 'by_severity', severity, count(*) FROM alerts GROUP BY 2
UNION ALL SELECT 'by_farm', farm_id, count(*) FROM alerts GROUP BY 2
UNION ALL SELECT 'daily_count', strftime(created_at, '%Y-%m-%d'), count(*) FROM alerts GROUP BY 2""",
    )
)
def rollup_alert_stats(spark, sf_dir):
    """Alerts in three saves, the first with wrong severities; counts follow."""
    rows = v.alerts(spark, sf_dir).select("id", "created_at", "severity", "farm_id")
    first, second, third = _saves(rows, "id")
    first = first.withColumn("severity", F.when(F.col("id") % 5 == 0, "critical").otherwise(F.col("severity")))
    folder = new_folder(spark, "alert-rollup")
    roll = rollups.alerts_rollup(spark, f"{folder}/alerts", f"{folder}/daily")
    storage.create_metrics(first, f"{folder}/alerts", "created_at")
    roll.refresh()
    for batch in (second, third):
        storage.save_metrics(batch, f"{folder}/alerts", keys=("id", "created_at"), date="created_at")
        roll.refresh()
    return rollups.alert_stats(roll.read())


def _logs(spark, sf_dir):
    rows = v.logs(spark, sf_dir).select("event_id", "timestamp", "level", "logger", "message")
    first, second, third = _saves(rows, "event_id")
    first = first.withColumn("level", F.when(F.col("event_id") % 5 == 0, "ERROR").otherwise(F.col("level")))
    folder = new_folder(spark, "log-rollup")
    roll = rollups.logs_rollup(spark, f"{folder}/logs", f"{folder}/daily")
    storage.create_metrics(first, f"{folder}/logs", "timestamp")
    roll.refresh()
    for batch in (second, third):
        storage.save_metrics(batch, f"{folder}/logs", keys=("event_id", "timestamp"), date="timestamp")
        roll.refresh()
    return roll.read()


@query(
    v.with_views(
        "logs",
        f"""SELECT 'total' AS section, 'total_logs' AS key, CAST(count(*) AS VARCHAR) AS value FROM logs
UNION ALL SELECT 'time_range', 'first', {time_text("min(timestamp)")} FROM logs
UNION ALL SELECT 'time_range', 'last', {time_text("max(timestamp)")} FROM logs
UNION ALL SELECT 'level_distribution', level, CAST(count(*) AS VARCHAR) FROM logs GROUP BY level
UNION ALL SELECT DISTINCT 'unique_loggers', logger, '1' FROM logs""",
    )
)
def rollup_log_levels(spark, sf_dir):
    return rollups.log_levels(_logs(spark, sf_dir))


@query(v.with_views("logs", "SELECT message AS key, count(*) AS errors FROM logs WHERE level IN ('ERROR', 'CRITICAL') GROUP BY message"))
def rollup_errors(spark, sf_dir):
    return rollups.errors_by_message(_logs(spark, sf_dir))


# Searches by index
@query(
    v.with_views(
        "alerts",
        f"""SELECT {ALERT_COLUMNS} FROM alerts WHERE lower(severity) = 'high' AND contains(lower(message), 'animal 1')""",
    )
)
def alert_search_indexed(spark, sf_dir):
    """Alerts added in two parts; the second search reads candidate blocks only."""
    rows = v.alerts(spark, sf_dir)
    index = si.alert_index(spark, new_folder(spark, "alert-index"), rows.columns)
    for k in (0, 1):
        index.add(rows.filter(F.col("id") % 2 == k))
    return si.search_alerts(index, "ANIMAL 1", severity="HIGH")


@query(v.with_views("logs", f"""SELECT {RECORD} FROM logs WHERE contains(lower(message), 'click user 3')"""))
def log_search_indexed(spark, sf_dir):
    rows = v.logs(spark, sf_dir)
    index = si.log_index(spark, new_folder(spark, "log-index"), rows.columns)
    index.add(rows)
    return si.search_logs(index, "CLICK user 3").select(*FIELDS)


@query(
    v.with_views(
        "logs",
        f"""SELECT {RECORD.replace("event_id, ", "")} FROM logs WHERE operation <> 'error'
AND timestamp >= TIMESTAMP '2024-01-10' AND timestamp <= TIMESTAMP '2024-01-20' AND level IN ('WARNING', 'ERROR', 'CRITICAL')""",
    )
)
def log_source_filtered(spark, sf_dir):
    """Text logs in day folders, read as a data source that takes times and levels."""
    log_source.register(spark)
    folder, lines = new_folder(spark, "log-source"), v.log_lines(spark, sf_dir)
    days = v.logs(spark, sf_dir).select("event_id", F.date_format("timestamp", "yyyy-MM-dd").alias("day"))
    lines.join(days, "event_id").select("line", "day").hint("rebalance", "day").write.partitionBy("day").text(folder)
    found = spark.read.format(log_source.NAME).load(folder)
    wanted = F.col("timestamp").between(F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"))
    return found.where(wanted & F.col("level").isin("WARNING", "ERROR", "CRITICAL")).select(*[c for c in FIELDS if c != "event_id"])
