"""Queries: listings, joins, summaries and reports of readings and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import ALERT_ACTIONS, METRICS, SUMMARY_ADVICE
from ..operators import alerts as al
from ..operators import filters, joins, reports, stats
from . import views as v
from .q_detection import CLUSTER_SQL, SEVERITY_SQL, Z_SQL, enriched, flagged
from .registry import day_text, query, rounded, time_text

AS_OF = f"TIMESTAMP '{v.METRICS_AS_OF}'"
ALERT_AS_OF = f"TIMESTAMP '{v.ALERTS_AS_OF}'"
ALERT_COLUMNS = f"""id, farm_id, severity, message, affected_animals, is_resolved,
       {time_text("created_at")} AS created_at"""
FLAGGED = f"WITH {Z_SQL}"


# Summaries
@query(
    v.with_views(
        "livestock metrics_raw",
        f"""{FLAGGED}
SELECT count(DISTINCT tag_id) AS total_animals, count(*) AS total_records,
       count(*) FILTER (is_anomaly) AS anomaly_count, count(DISTINCT farm_id) AS farms_monitored
FROM enriched WHERE date >= {AS_OF} - INTERVAL 30 DAY""",
    )
)
def metrics_summary(spark, sf_dir):
    return reports.metrics_summary(flagged(spark, sf_dir), v.METRICS_AS_OF)


@query(
    v.with_views(
        "alerts",
        """SELECT count(*) AS active_alerts, count(*) FILTER (severity = 'critical') AS critical_alerts
FROM alerts WHERE NOT is_resolved""",
    )
)
def alert_summary(spark, sf_dir):
    return reports.alert_summary(v.alerts(spark, sf_dir))


@query(
    v.with_views(
        "livestock metrics_raw",
        f"""{FLAGGED}
SELECT {day_text("date")} AS day, count(*) AS total_records, count(*) FILTER (is_anomaly) AS anomalies,
       {rounded("avg(anomaly_score)")} AS avg_score
FROM enriched WHERE date >= {AS_OF} - INTERVAL 30 DAY GROUP BY {day_text("date")}""",
    )
)
def anomaly_timeline(spark, sf_dir):
    return reports.anomaly_timeline(flagged(spark, sf_dir), v.METRICS_AS_OF, 30)


@query(
    v.with_views(
        "livestock",
        """SELECT 'by_type' AS section, animal_type, count(*) AS animals, NULL::BIGINT AS farms
FROM livestock WHERE is_active GROUP BY animal_type
UNION ALL
SELECT 'total', NULL, count(*), count(DISTINCT farm_id) FROM livestock WHERE is_active""",
    )
)
def animal_summary_rollup(spark, sf_dir):
    return reports.animal_summary(v.livestock(spark, sf_dir))


@query(
    v.with_views(
        "livestock metrics_raw",
        f"""{FLAGGED}
SELECT coalesce(animal_type, 'all') AS animal_type, count(*) AS records,
       count(*) FILTER (is_anomaly) AS anomalies,
       {rounded("count(*) FILTER (is_anomaly) * 100e0 / count(*)")} AS anomaly_rate
FROM enriched GROUP BY ROLLUP (animal_type)""",
    )
)
def anomaly_by_type(spark, sf_dir):
    return reports.anomaly_by_type(flagged(spark, sf_dir))


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
def type_distribution(spark, sf_dir):
    return reports.type_distribution(enriched(spark, sf_dir))


@query(
    v.with_views(
        "livestock metrics_raw alerts",
        f"""{FLAGGED},
t AS (SELECT count(DISTINCT tag_id) AS a, count(*) AS r, count(DISTINCT farm_id) AS f,
             count(*) FILTER (is_anomaly) AS n FROM enriched),
newest AS (SELECT * FROM alerts WHERE created_at <= {ALERT_AS_OF} ORDER BY created_at DESC, id DESC LIMIT 5)
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
    FROM enriched GROUP BY animal_type
UNION ALL SELECT 'recent_alerts', CAST(id AS VARCHAR), upper(severity) || ': Farm ' || farm_id || ' - '
    || affected_animals || ' animals (' || {day_text("created_at")} || ')' FROM newest""",
    )
)
def daily_report(spark, sf_dir):
    return reports.daily_report(flagged(spark, sf_dir), v.alerts(spark, sf_dir), v.ALERTS_AS_OF)


_ADVICE = "\nUNION ALL ".join(
    f"SELECT 5, 0, {i + 1}, '{i}. {t}'" for i, t in enumerate(SUMMARY_ADVICE["alerts"], 1)
)


@query(
    v.with_views(
        "livestock metrics_raw",
        f"""{FLAGGED}, {CLUSTER_SQL},
t AS (SELECT count(*) AS r, count(*) FILTER (is_anomaly) AS n FROM enriched),
types AS (SELECT animal_type, count(*) FILTER (is_anomaly) AS n, row_number() OVER (ORDER BY animal_type) - 1 AS i
          FROM enriched WHERE animal_type IS NOT NULL GROUP BY animal_type),
numbered AS (SELECT *, row_number() OVER (ORDER BY start_date, farm_id) AS i,
                    CASE WHEN affected_animals >= 10 OR avg_anomaly_score >= 7 THEN 'critical'
                         WHEN affected_animals >= 5 OR avg_anomaly_score >= 5 THEN 'high'
                         WHEN affected_animals >= 3 OR avg_anomaly_score >= 3 THEN 'medium' ELSE 'low' END AS severity
             FROM clusters)
SELECT 0 AS section, 0 AS item, 0 AS line_no, repeat('=', 60) AS line
UNION ALL SELECT 0, 0, 2, repeat('=', 60)
UNION ALL SELECT 0, 0, 1, 'HERD HEALTH MONITORING SUMMARY REPORT'
UNION ALL SELECT 1, 0, 0, 'ANOMALY SUMMARY'
UNION ALL SELECT 1, 0, 1, repeat('-', 40)
UNION ALL SELECT 1, 0, 2, 'Total Records Analyzed: ' || r FROM t
UNION ALL SELECT 1, 0, 3, 'Anomalies Detected: ' || n FROM t
UNION ALL SELECT 1, 0, 4, 'Anomaly Rate: ' || printf('%.1f%%', n * 100e0 / r) FROM t
UNION ALL SELECT 2, i, 0, '  ' || upper(animal_type[1]) || animal_type[2:] || ': ' || n FROM types
UNION ALL SELECT 3, 0, 0, 'OUTBREAK ALERTS'
UNION ALL SELECT 3, 0, 1, repeat('-', 40)
UNION ALL SELECT 4, i - 1, 0, 'Alert ' || i || ':' FROM numbered
UNION ALL SELECT 4, i - 1, 1, '  Farm: ' || farm_id FROM numbered
UNION ALL SELECT 4, i - 1, 2, '  Severity: ' || severity FROM numbered
UNION ALL SELECT 4, i - 1, 3, '  Affected Animals: ' || affected_animals FROM numbered
UNION ALL SELECT 4, i - 1, 4, '  Start Date: ' || {day_text("start_date")} FROM numbered
UNION ALL SELECT 5, 0, 0, 'RECOMMENDATIONS'
UNION ALL SELECT 5, 0, 1, repeat('-', 40)
UNION ALL {_ADVICE}""",
    )
)
def summary_report(spark, sf_dir):
    from ..operators import clusters as cl

    readings = flagged(spark, sf_dir)
    found = cl.with_severity(cl.detect_clusters(readings))
    found = found.withColumns({"created_at": F.col("start_date"), "id": F.col("farm_id")})
    return reports.summary_report(readings, found)


HTML_PAGE = v.with_views(
    "livestock metrics_raw",
    f"""{FLAGGED}, {CLUSTER_SQL},
t AS (SELECT count(DISTINCT tag_id) AS a, count(*) AS r, count(*) FILTER (is_anomaly) AS n,
             (SELECT count(*) FROM clusters) AS c FROM enriched),
types AS (SELECT animal_type, count(*) AS r, row_number() OVER (ORDER BY animal_type) - 1 AS i
          FROM enriched WHERE animal_type IS NOT NULL GROUP BY animal_type),
numbered AS (SELECT *, row_number() OVER (ORDER BY start_date, farm_id) - 1 AS i, upper({SEVERITY_SQL}) AS severity
             FROM clusters),
heading AS (SELECT 'Herd Health Monitoring Report' AS title)
SELECT 0 AS section, 0 AS item, 0 AS line_no,
  '<!DOCTYPE html><html><head><title>' || title || '</title></head><body><h1>' || title || '</h1>' AS line FROM heading
UNION ALL SELECT 0, 0, 1, '<h2>Summary Statistics</h2>'
UNION ALL SELECT 0, 0, 2, '<div class="stat-box"><h3>Animals Monitored</h3><p>' || a || '</p></div>' FROM t
UNION ALL SELECT 0, 0, 3, '<div class="stat-box"><h3>Health Records</h3><p>' || r || '</p></div>' FROM t
UNION ALL SELECT 0, 0, 4, '<div class="stat-box"><h3>Anomalies Detected</h3><p>' || n || '</p></div>' FROM t
UNION ALL SELECT 0, 0, 5, '<div class="stat-box"><h3>Outbreak Clusters</h3><p>' || c || '</p></div>' FROM t
UNION ALL SELECT 0, 0, 6, '<h2>Animal Distribution</h2>'
UNION ALL SELECT 0, 0, 7, '<table><tr><th>Animal Type</th><th>Count</th><th>Percentage</th></tr>'
UNION ALL SELECT 1, i, 0, '<tr><td>' || upper(animal_type[1]) || animal_type[2:] || '</td><td>' || r || '</td><td>'
  || printf('%.1f%%', r * 100e0 / (SELECT a FROM t)) || '</td></tr>' FROM types
UNION ALL SELECT 2, 0, 0, '</table><h2>Outbreak Clusters</h2>'
UNION ALL SELECT 2, 0, 1, CASE WHEN c > 0 THEN '<table><tr><th>Farm ID</th><th>Start Date</th><th>Affected Animals</th>'
  || '<th>Severity</th><th>Metrics Affected</th></tr>'
  ELSE '<table><tr><td>No outbreak clusters detected during this period.</td></tr>' END FROM t
UNION ALL SELECT 3, i, 0, '<tr><td>' || farm_id || '</td><td>' || {day_text("start_date")} || '</td><td>'
  || affected_animals || '</td><td>' || severity || '</td><td>' || replace(metrics_affected, ',', ', ') || '</td></tr>'
FROM numbered
UNION ALL SELECT 4, 0, 0, '</table></body></html>'""",
)


@query(HTML_PAGE)
def html_report_page(spark, sf_dir):
    """All lines of the HTML report with their places."""
    from ..operators import clusters as cl

    readings = flagged(spark, sf_dir)
    return reports.html_report(readings, cl.with_severity(cl.detect_clusters(readings)))


@query(HTML_PAGE)
def html_report_tables(spark, sf_dir):
    return html_report_page(spark, sf_dir)


# Listings
@query(
    v.with_views(
        "livestock metrics_raw",
        f"""{FLAGGED}
SELECT arrival_id, tag_id, {time_text("date")} AS date, {", ".join(f"{rounded(m)} AS {m}" for m in METRICS)},
       is_anomaly, {rounded("anomaly_score")} AS anomaly_score
FROM flagged WHERE date >= {AS_OF} - INTERVAL 30 DAY ORDER BY flagged.date DESC, arrival_id DESC LIMIT 1000""",
    )
)
def latest_metrics_topn(spark, sf_dir):
    return filters.latest_metrics(
        flagged(spark, sf_dir), v.METRICS_AS_OF, ["tag_id", "date", *METRICS, "is_anomaly", "anomaly_score"]
    )


@query(v.with_views("alerts", f"SELECT {ALERT_COLUMNS} FROM alerts WHERE NOT is_resolved AND severity = 'critical'"))
def active_alerts(spark, sf_dir):
    return filters.active_alerts(v.alerts(spark, sf_dir), "critical")


@query(
    v.with_views(
        "alerts",
        f"""SELECT {ALERT_COLUMNS} FROM (SELECT * FROM alerts WHERE NOT is_resolved
ORDER BY created_at DESC, id DESC LIMIT 50)""",
    )
)
def latest_alerts_topn(spark, sf_dir):
    return filters.active_alerts(v.alerts(spark, sf_dir), limit=50)


@query(
    v.with_views(
        "livestock metrics_raw",
        f"""SELECT arrival_id, tag_id, {time_text("date")} AS date, animal_type, farm_id
FROM metrics_raw LEFT JOIN livestock USING (tag_id)
WHERE date >= {AS_OF} - INTERVAL 14 DAY AND farm_id = 5 AND animal_type = 'cattle'""",
    )
)
def recent_metrics_by_farm(spark, sf_dir):
    return filters.recent_metrics(enriched(spark, sf_dir), v.METRICS_AS_OF, 14, 5, "cattle").select(
        "arrival_id", "tag_id", "date", "animal_type", "farm_id"
    )


@query(
    v.with_views(
        "livestock metrics_raw",
        f"""{FLAGGED}
SELECT arrival_id, tag_id, {time_text("date")} AS date, animal_type, farm_id,
       {", ".join(f"{rounded(m)} AS {m}" for m in METRICS)}, is_anomaly, {rounded("anomaly_score")} AS anomaly_score
FROM enriched WHERE is_anomaly AND date >= {AS_OF} - INTERVAL 7 DAY""",
    )
)
def anomaly_extract(spark, sf_dir):
    from ..sources.writers import essential_columns

    found = filters.anomalies(flagged(spark, sf_dir), v.METRICS_AS_OF, 7)
    return found.select("arrival_id", *essential_columns(found))


@query(
    v.with_views(
        "alerts", f"SELECT {ALERT_COLUMNS} FROM alerts WHERE created_at >= {ALERT_AS_OF} - INTERVAL 90 DAY"
    )
)
def alert_extract(spark, sf_dir):
    return filters.alerts_between(v.alerts(spark, sf_dir), v.ALERTS_AS_OF, 90)


@query(
    v.with_views(
        "metrics_raw",
        f"""SELECT arrival_id, tag_id, {time_text("date")} AS date, {", ".join(f"{rounded(m)} AS {m}" for m in METRICS)}
FROM metrics_raw WHERE date >= {AS_OF} - INTERVAL 7 DAY""",
    )
)
def metrics_extract(spark, sf_dir):
    return filters.recent(v.metrics_raw(spark, sf_dir).drop("value"), v.METRICS_AS_OF, 7)


@query(
    v.with_views(
        "metrics_raw livestock",
        f"{FLAGGED} "
        + " UNION ALL ".join(
            f"""SELECT tag_id, {time_text("date")} AS date, '{m}' AS metric, {rounded(m)} AS value,
{m}_anomaly AS is_anomaly FROM flagged WHERE {m} IS NOT NULL"""
            for m in METRICS
        ),
    )
)
def animal_timeline_long(spark, sf_dir):
    return filters.timeline_long(flagged(spark, sf_dir), METRICS)


# Joins and updates
@query(
    v.with_views(
        "livestock metrics_raw",
        "SELECT * FROM livestock WHERE tag_id NOT IN (SELECT tag_id FROM metrics_raw)",
    )
)
def animals_without_readings(spark, sf_dir):
    return joins.animals_without_readings(v.livestock(spark, sf_dir), v.metrics_raw(spark, sf_dir))


@query(
    v.with_views(
        "livestock metrics_raw", "SELECT * FROM livestock WHERE tag_id IN (SELECT tag_id FROM metrics_raw)"
    )
)
def animals_with_readings(spark, sf_dir):
    return joins.animals_with_readings(v.livestock(spark, sf_dir), v.metrics_raw(spark, sf_dir))


@query(
    v.with_views(
        "livestock metrics_raw",
        """SELECT arrival_id, tag_id FROM metrics_raw
WHERE tag_id NOT IN (SELECT tag_id FROM livestock WHERE is_active)""",
    )
)
def readings_without_animal(spark, sf_dir):
    active = v.livestock(spark, sf_dir).filter("is_active")
    return joins.readings_without_animal(v.metrics_raw(spark, sf_dir), active).select("arrival_id", "tag_id")


@query(
    v.with_views(
        "metrics_raw",
        f"""WITH stored AS (SELECT tag_id, date, temperature, heart_rate FROM metrics_raw WHERE date < {AS_OF} - INTERVAL 7 DAY),
incoming AS (SELECT tag_id, date, temperature FROM (
    SELECT tag_id, date, arrival_id, temperature + 1 AS temperature FROM metrics_raw
    WHERE date >= {AS_OF} - INTERVAL 14 DAY
    UNION ALL
    SELECT tag_id, date, arrival_id + 1000000000, temperature + 2 FROM metrics_raw
    WHERE date >= {AS_OF} - INTERVAL 3 DAY)
  QUALIFY row_number() OVER (PARTITION BY tag_id, date ORDER BY arrival_id DESC) = 1)
SELECT coalesce(i.tag_id, s.tag_id) AS tag_id, {time_text("coalesce(i.date, s.date)")} AS date,
       {rounded("CASE WHEN i.tag_id IS NOT NULL THEN i.temperature ELSE s.temperature END")} AS temperature,
       {rounded("s.heart_rate")} AS heart_rate
FROM stored s FULL JOIN incoming i ON s.tag_id = i.tag_id AND s.date = i.date""",
    )
)
def upsert_metrics(spark, sf_dir):
    readings = v.metrics_raw(spark, sf_dir)
    cut = lambda days: F.lit(v.METRICS_AS_OF).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")
    stored = readings.filter(F.col("date") < cut(7)).select("tag_id", "date", "temperature", "heart_rate")
    batch = readings.filter(F.col("date") >= cut(14)).select(
        "tag_id", "date", "arrival_id", (F.col("temperature") + 1).alias("temperature")
    )
    again = readings.filter(F.col("date") >= cut(3)).select(
        "tag_id", "date", (F.col("arrival_id") + 1000000000).alias("arrival_id"),
        (F.col("temperature") + 2).alias("temperature"),
    )
    return joins.upsert(stored, batch.unionByName(again), ["tag_id", "date"], "arrival_id")


@query(
    v.with_views(
        "livestock",
        """SELECT tag_id, CASE WHEN s.s_suppkey IS NOT NULL THEN 'alpaca' ELSE animal_type END AS animal_type,
       CASE WHEN s.s_suppkey IS NOT NULL THEN s_nationkey ELSE farm_id END AS farm_id, age_months, is_active
FROM livestock LEFT JOIN supplier s ON tag_id = s_suppkey
UNION ALL
SELECT s_suppkey, 'alpaca', s_nationkey, NULL, NULL FROM supplier WHERE s_suppkey NOT IN (SELECT tag_id FROM livestock)""",
    )
)
def upsert_animals(spark, sf_dir):
    arriving = v.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("tag_id"), F.lit("alpaca").alias("animal_type"), F.col("s_nationkey").alias("farm_id")
    )
    return joins.upsert(v.livestock(spark, sf_dir), arriving, ["tag_id"])


# Alerts
@query(
    v.with_views(
        "alerts",
        f"""SELECT id, farm_id, severity, message, affected_animals, CASE WHEN id = 7 THEN true ELSE is_resolved END AS is_resolved,
       {time_text("created_at")} AS created_at,
       CASE WHEN id = 7 THEN {time_text(ALERT_AS_OF)} END AS end_date FROM alerts""",
    )
)
def resolve_alert(spark, sf_dir):
    return al.resolve(v.alerts(spark, sf_dir), 7, v.ALERTS_AS_OF)


@query(
    v.with_views(
        "alerts",
        """SELECT 'total_alerts' AS section, 'all' AS key, count(*) AS alerts FROM alerts
UNION ALL SELECT 'by_severity', severity, count(*) FROM alerts GROUP BY 2
UNION ALL SELECT 'by_farm', farm_id, count(*) FROM alerts GROUP BY 2
UNION ALL SELECT 'daily_count', strftime(created_at, '%Y-%m-%d'), count(*) FROM alerts GROUP BY 2""",
    )
)
def alert_stats_sets(spark, sf_dir):
    return al.stats(v.alerts(spark, sf_dir))


@query(
    v.with_views(
        "alerts",
        f"""SELECT {ALERT_COLUMNS} FROM alerts WHERE lower(severity) = 'high' AND lower(farm_id) = 'farm-0007'
AND contains(lower(message), 'animal 1')""",
    )
)
def alert_search(spark, sf_dir):
    return al.search(v.alerts(spark, sf_dir), "ANIMAL 1", "HIGH", "farm-0007")


@query(v.with_views("alerts", f"SELECT {ALERT_COLUMNS} FROM alerts WHERE severity IN ('high', 'critical')"))
def alerts_over_threshold(spark, sf_dir):
    return al.over_threshold(v.alerts(spark, sf_dir))


@query(
    v.with_views(
        "alerts",
        f"""SELECT {ALERT_COLUMNS} FROM (SELECT * FROM alerts WHERE severity = 'medium'
ORDER BY created_at DESC, id DESC LIMIT 20)""",
    )
)
def alert_history_topn(spark, sf_dir):
    return al.history(v.alerts(spark, sf_dir), severity="Medium")


def _actions(name: str) -> str:
    return " || chr(10) || ".join(f"'{i}. {t}'" for i, t in enumerate(ALERT_ACTIONS[name], 1))


@query(
    v.with_views(
        "alerts",
        f"""SELECT id, '[' || upper(severity) || '] Herd Outbreak Alert - Farm ' || farm_id || ' - '
    || affected_animals || ' Animals Affected' AS subject,
  concat_ws(chr(10), 'HERD OUTBREAK ALERT', repeat('=', 50), '', 'ALERT SEVERITY: ' || upper(severity),
    'FARM ID: ' || farm_id, 'DETECTION TIME: {v.ALERTS_AS_OF}',
    'ALERT GENERATED: ' || strftime(created_at, '%Y-%m-%d %H:%M:%S'), '', 'OUTBREAK DETAILS:', repeat('-', 20),
    'Affected Animals: ' || affected_animals, chr(10) || 'Description: ' || message,
    chr(10) || 'RECOMMENDED ACTIONS:', repeat('-', 20),
    CASE severity WHEN 'critical' THEN {_actions("critical")} WHEN 'high' THEN {_actions("high")}
      WHEN 'medium' THEN {_actions("medium")} ELSE {_actions("low")} END) AS body,
  '[' || upper(severity) || ' ALERT] Farm: ' || farm_id || chr(10) || 'Affected Animals: ' || affected_animals
    || chr(10) || 'Description: ' || message || chr(10) AS short
FROM alerts""",
    )
)
def alert_messages(spark, sf_dir):
    rows = v.alerts(spark, sf_dir).withColumn("description", F.col("message"))
    return rows.select(
        "id", al.subject().alias("subject"), al.body(rows, v.ALERTS_AS_OF).alias("body"),
        al.short_message().alias("short"),
    )


@query(
    v.with_views(
        "alerts",
        f"""SELECT id, '[{v.ALERTS_AS_OF}] [' || upper(severity) || '] Farm: ' || farm_id || ' | Animals: '
    || affected_animals || ' | ' || message AS line, {time_text(ALERT_AS_OF)} AS timestamp, severity,
       '{v.ALERTS_AS_OF[:10]}' AS day FROM alerts""",
    )
)
def alert_log_lines(spark, sf_dir):
    logged = al.with_defaults(v.alerts(spark, sf_dir), v.ALERTS_AS_OF)
    return logged.select("id", "line", "timestamp", "severity", "day")


@query(v.with_views("alerts", "SELECT severity, count(*) AS n FROM alerts GROUP BY severity"))
def alerts_by_severity(spark, sf_dir):
    return stats.counts_by(v.alerts(spark, sf_dir), "severity")
