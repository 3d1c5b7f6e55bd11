"""The stored tables of the domain, as views over the given Parquet tables.

Each view exists twice: as a DataFrame for the queries and as SQL text for the cross-check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed points in time that stand in for "now".
METRICS_AS_OF = "2024-01-31 00:00:00"
QUALITY_AS_OF = "2024-03-05 00:00:00"
ALERTS_AS_OF = "2001-08-01 00:00:00"

ANIMAL_TYPES = {"BUILDING": "cattle", "AUTOMOBILE": "sheep", "MACHINERY": "goat", "HOUSEHOLD": "swine"}
SEVERITIES = {"1": "critical", "2": "high", "3": "medium", "4": "low"}
HERD_TYPES = ("cattle", "sheep", "goat", "swine", "poultry")
LEVELS = {"error": "ERROR", "signup": "CRITICAL", "click": "WARNING", "purchase": "INFO"}


def _choose(column, table: dict, otherwise):
    out = None
    for key, value in table.items():
        out = F.when(column == key, F.lit(value)) if out is None else out.when(column == key, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def livestock(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("tag_id"),
        _choose(F.col("c_mktsegment"), ANIMAL_TYPES, "poultry").alias("animal_type"),
        (F.col("c_custkey") % 114 + 6).cast("int").alias("age_months"),
        F.col("c_nationkey").alias("farm_id"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
    )


def metrics_raw(spark, sf_dir) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("arrival_id"),
        F.col("user_id").alias("tag_id"),
        F.col("ts").alias("date"),
        F.when(kind != "error", 37 + value / 100).alias("temperature"),
        F.when(kind != "view", 40 + value).alias("heart_rate"),
        F.when(kind != "click", value / 50).alias("activity_level"),
        "value",
    )


def metrics_daily(spark, sf_dir) -> DataFrame:
    return metrics_raw(spark, sf_dir).select(
        "arrival_id", "tag_id", F.to_date("date").alias("date"),
        "temperature", "heart_rate", "activity_level",
    )


def series_daily(spark, sf_dir) -> DataFrame:
    return (
        metrics_raw(spark, sf_dir)
        .groupBy("tag_id", F.to_date("date").alias("day"))
        .agg(F.max("value").alias("value"))
    )


def alerts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("FARM-"), F.lpad((F.col("o_custkey") % 25).cast("string"), 4, "0")).alias("farm_id"),
        _choose(F.substring("o_orderpriority", 1, 1), SEVERITIES, "info").alias("severity"),
        F.concat(F.lit("alert for animal "), F.col("o_custkey").cast("string")).alias("message"),
        (1 + F.col("o_orderkey") % 12).alias("affected_animals"),
        (F.col("o_orderstatus") == "F").alias("is_resolved"),
        F.col("o_orderdate").alias("created_at"),
    )


def herd_daily(spark, sf_dir) -> DataFrame:
    part = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("FARM-"), F.lpad(F.col("l_suppkey").cast("string"), 4, "0")).alias("farm_id"),
        F.col("l_shipdate").alias("date"),
        _choose(part % 6, dict(enumerate(HERD_TYPES)), "horse").alias("animal_type"),
        F.col("l_quantity").cast("int").alias("total_animals"),
        F.col("l_linenumber").alias("sick_animals"),
        F.round(F.col("l_discount") * 100).cast("int").alias("deceased_animals"),
        (30 + part % 20).cast("double").alias("avg_temperature"),
        F.round(F.col("l_tax") * 1500).cast("double").alias("feed_intake_percent"),
        F.when(part % 11 != 0, F.col("l_linenumber") * F.lit(1.5)).alias("activity_level"),
    )


def logs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").alias("timestamp"),
        _choose(F.col("event_type"), LEVELS, "DEBUG").alias("level"),
        F.concat(F.lit("module"), (F.col("user_id") % 5).cast("string")).alias("logger"),
        F.concat(F.col("event_type"), F.lit(" user "), (F.col("user_id") % 7).cast("string")).alias("message"),
        F.col("event_type").alias("operation"),
        F.col("value").alias("duration_ms"),
        "props",
    )


def log_lines(spark, sf_dir) -> DataFrame:
    """Log text as a file would hold it: JSON lines, JSON inside other output, plain text."""
    entry = F.to_json(
        F.struct(
            F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
            "level", "logger", "message", "operation", "duration_ms",
        )
    )
    kind = F.col("operation")
    return logs(spark, sf_dir).select(
        "event_id",
        F.when(kind == "error", F.concat(F.lit("plain text "), "message"))
        .when(kind == "click", F.concat(F.lit("[worker] "), entry))
        .when(kind == "signup", F.concat(F.lit("  "), entry))
        .when(kind == "purchase", F.concat(F.lit("stdout | "), entry, F.lit(" |")))
        .otherwise(entry)
        .alias("line"),
    )


SQL = {
    "livestock": """
  SELECT c_custkey AS tag_id,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'cattle' WHEN 'AUTOMOBILE' THEN 'sheep'
              WHEN 'MACHINERY' THEN 'goat' WHEN 'HOUSEHOLD' THEN 'swine' ELSE 'poultry' END AS animal_type,
         CAST(c_custkey % 114 + 6 AS INT) AS age_months,
         c_nationkey AS farm_id, c_acctbal >= 0 AS is_active
  FROM customer""",
    "metrics_raw": """
  SELECT event_id AS arrival_id, user_id AS tag_id, ts AS date,
         CASE WHEN event_type <> 'error' THEN 37 + value / 100 END AS temperature,
         CASE WHEN event_type <> 'view'  THEN 40 + value END AS heart_rate,
         CASE WHEN event_type <> 'click' THEN value / 50 END AS activity_level, value
  FROM events""",
    "metrics_daily": """
  SELECT arrival_id, tag_id, CAST(date AS DATE) AS date, temperature, heart_rate, activity_level
  FROM metrics_raw""",
    "series_daily": """
  SELECT tag_id, CAST(date AS DATE) AS day, max(value) AS value FROM metrics_raw GROUP BY 1, 2""",
    "alerts": """
  SELECT o_orderkey AS id, concat('FARM-', lpad(CAST(o_custkey % 25 AS VARCHAR), 4, '0')) AS farm_id,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high'
              WHEN '3' THEN 'medium' WHEN '4' THEN 'low' ELSE 'info' END AS severity,
         concat('alert for animal ', CAST(o_custkey AS VARCHAR)) AS message,
         1 + o_orderkey % 12 AS affected_animals,
         o_orderstatus = 'F' AS is_resolved, o_orderdate AS created_at
  FROM orders""",
    "herd_daily": """
  SELECT concat('FARM-', lpad(CAST(l_suppkey AS VARCHAR), 4, '0')) AS farm_id, l_shipdate AS date,
         CASE l_partkey % 6 WHEN 0 THEN 'cattle' WHEN 1 THEN 'sheep' WHEN 2 THEN 'goat'
              WHEN 3 THEN 'swine' WHEN 4 THEN 'poultry' ELSE 'horse' END AS animal_type,
         CAST(l_quantity AS INT) AS total_animals, l_linenumber AS sick_animals,
         CAST(round(l_discount * 100) AS INT) AS deceased_animals,
         CAST(30 + l_partkey % 20 AS DOUBLE) AS avg_temperature,
         CAST(round(l_tax * 1500) AS DOUBLE) AS feed_intake_percent,
         CASE WHEN l_partkey % 11 <> 0 THEN l_linenumber * 1.5e0 END AS activity_level
  FROM lineitem""",
    "logs": """
  SELECT event_id, ts AS timestamp,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'CRITICAL'
              WHEN 'click' THEN 'WARNING' WHEN 'purchase' THEN 'INFO' ELSE 'DEBUG' END AS level,
         concat('module', CAST(user_id % 5 AS VARCHAR)) AS logger,
         concat(event_type, ' user ', CAST(user_id % 7 AS VARCHAR)) AS message,
         event_type AS operation, value AS duration_ms, props
  FROM events""",
}
_NEEDS = {"metrics_daily": ["metrics_raw"], "series_daily": ["metrics_raw"]}


def with_views(names: str, body: str) -> str:
    """SQL text: the named views as common table expressions, then ``body``."""
    wanted: list[str] = []
    for name in names.split():
        for need in [*_NEEDS.get(name, []), name]:
            if need not in wanted:
                wanted.append(need)
    ctes = ",\n".join(f"{name} AS ({SQL[name]}\n)" for name in wanted)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
