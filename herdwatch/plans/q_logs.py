"""Queries: structured logs."""

from __future__ import annotations

from ..operators import logs as lg
from . import views as v
from .registry import query, rounded, time_text

AS_OF = f"TIMESTAMP '{v.METRICS_AS_OF}'"
RECORD = f"""event_id, {time_text("timestamp")} AS timestamp, level, logger, message, operation,
       {rounded("duration_ms")} AS duration_ms"""
FIELDS = ("event_id", "timestamp", "level", "logger", "message", "operation", "duration_ms")


@query(
    v.with_views(
        "logs",
        f"""SELECT {RECORD} FROM logs WHERE operation <> 'error'""",
    )
)
def log_parse(spark, sf_dir):
    return lg.parse_lines(v.log_lines(spark, sf_dir)).select(*FIELDS)


@query(
    v.with_views(
        "logs",
        f"""SELECT {RECORD} FROM logs WHERE timestamp >= TIMESTAMP '2024-01-10' AND timestamp <= TIMESTAMP '2024-01-20'
AND level IN ('WARNING', 'ERROR', 'CRITICAL')""",
    )
)
def log_filter_level(spark, sf_dir):
    return lg.read_logs(
        v.logs(spark, sf_dir), "2024-01-10 00:00:00", "2024-01-20 00:00:00", "WARNING"
    ).select(*FIELDS)


@query(
    v.with_views(
        "logs",
        f"""SELECT {RECORD} FROM logs WHERE contains(lower(message), 'click user 3')
AND timestamp >= {AS_OF} - INTERVAL 240 HOUR""",
    )
)
def log_search(spark, sf_dir):
    return lg.search_logs(v.logs(spark, sf_dir), "CLICK user 3", v.METRICS_AS_OF, 240).select(*FIELDS)


@query(
    v.with_views(
        "logs",
        f"""WITH rows AS (SELECT * FROM logs WHERE timestamp >= {AS_OF} - INTERVAL 240 HOUR)
SELECT 'total' AS section, 'total_logs' AS key, CAST(count(*) AS VARCHAR) AS value FROM rows
UNION ALL SELECT 'time_range', 'first', {time_text("min(timestamp)")} FROM rows
UNION ALL SELECT 'time_range', 'last', {time_text("max(timestamp)")} FROM rows
UNION ALL SELECT 'level_distribution', level, CAST(count(*) AS VARCHAR) FROM rows GROUP BY level
UNION ALL SELECT DISTINCT 'unique_loggers', logger, '1' FROM rows
UNION ALL SELECT 'recent_messages', CAST(event_id AS VARCHAR), message FROM (
  SELECT * FROM rows ORDER BY timestamp DESC, event_id DESC LIMIT 5)""",
    )
)
def log_summary(spark, sf_dir):
    return lg.log_summary(v.logs(spark, sf_dir), v.METRICS_AS_OF, 240)


@query(
    v.with_views(
        "logs",
        """SELECT message AS key, count(*) AS errors FROM logs WHERE level IN ('ERROR', 'CRITICAL')
GROUP BY message ORDER BY errors DESC, key LIMIT 10""",
    )
)
def log_errors_top(spark, sf_dir):
    return lg.top_errors(v.logs(spark, sf_dir))


@query(
    v.with_views(
        "logs",
        """SELECT logger AS key, count(*) AS errors FROM logs WHERE level IN ('ERROR', 'CRITICAL') GROUP BY logger""",
    )
)
def log_errors_by_module(spark, sf_dir):
    return lg.errors_by(v.logs(spark, sf_dir).withColumnRenamed("logger", "module"), "module")


PERFORMANCE = f"""SELECT operation, count(*) AS count, {rounded("avg(duration_ms)")} AS avg_ms,
       {rounded("min(duration_ms)")} AS min_ms, {rounded("max(duration_ms)")} AS max_ms,
       {rounded("list_sort(list(duration_ms))[CAST(floor(count(*) * 0.95e0) AS INT) + 1]")} AS p95_ms
FROM logs GROUP BY operation"""


@query(v.with_views("logs", PERFORMANCE))
def log_performance_p95(spark, sf_dir):
    return lg.performance(v.logs(spark, sf_dir))


@query(v.with_views("logs", PERFORMANCE + " ORDER BY avg(duration_ms) DESC, operation LIMIT 5"))
def log_slowest(spark, sf_dir):
    return lg.slowest(v.logs(spark, sf_dir))


@query(
    v.with_views(
        "logs",
        f"""SELECT {RECORD} FROM (SELECT * FROM logs WHERE level IN ('ERROR', 'CRITICAL')
ORDER BY timestamp DESC, event_id DESC LIMIT 10)""",
    )
)
def log_recent(spark, sf_dir):
    return lg.recent_logs(v.logs(spark, sf_dir), 10, "ERROR").select(*FIELDS)
