"""Queries: cleaning, scaling, table statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import METRICS
from ..functions import scalars as s
from ..operators import clean as c
from ..operators import joins, normalize, stats
from . import views as v
from .q_detection import enriched
from .registry import TIME_FORMAT, day_text, query, rounded, time_text

FILL_SQL = """filled AS (
  SELECT * REPLACE (""" + ", ".join(
    f"coalesce(last_value({m} IGNORE NULLS) OVER past, first_value({m} IGNORE NULLS) OVER future) AS {m}"
    for m in METRICS
) + """) FROM {source}
  WINDOW past AS (PARTITION BY tag_id ORDER BY arrival_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         future AS (PARTITION BY tag_id ORDER BY arrival_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
IMPUTE_SQL = (
    "imputed AS (SELECT * REPLACE ("
    + ", ".join(f"coalesce({m}, (SELECT avg({m}) FROM filled)) AS {m}" for m in METRICS)
    + ") FROM filled)"
)
ROUNDED_METRICS = ", ".join(f"{rounded(m)} AS {m}" for m in METRICS)


@query(
    v.with_views(
        "metrics_raw",
        f"WITH {FILL_SQL.format(source='metrics_raw')} SELECT arrival_id, tag_id, {ROUNDED_METRICS} FROM filled",
    )
)
def clean_fill(spark, sf_dir):
    return c.fill_missing(v.metrics_raw(spark, sf_dir)).select("arrival_id", "tag_id", *METRICS)


@query(
    v.with_views(
        "metrics_raw",
        "SELECT arrival_id, "
        + ", ".join(f"{rounded(f'coalesce({m}, (SELECT avg({m}) FROM metrics_raw))')} AS {m}" for m in METRICS)
        + " FROM metrics_raw",
    )
)
def clean_mean_impute(spark, sf_dir):
    return c.impute_mean(v.metrics_raw(spark, sf_dir)).select("arrival_id", *METRICS)


@query(
    v.with_views(
        "metrics_daily",
        f"""SELECT arrival_id, tag_id, {day_text("date")} AS date, {ROUNDED_METRICS} FROM metrics_daily
QUALIFY row_number() OVER (PARTITION BY tag_id, date ORDER BY arrival_id) = 1""",
    )
)
def clean_dedup_first(spark, sf_dir):
    return c.remove_duplicates(v.metrics_daily(spark, sf_dir))


def dirty(spark, sf_dir):
    """Readings as text, some of them unreadable."""
    kind = F.col("event_type")
    return v.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("arrival_id"),
        F.when(kind == "signup", "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("date"),
        F.when(kind == "view", F.concat(F.col("value").cast("string"), F.lit(" C")))
        .when(kind == "click", "")
        .otherwise(F.col("value").cast("string"))
        .alias("temperature"),
    )


@query(
    f"""WITH dirty AS (
  SELECT event_id AS arrival_id,
         CASE WHEN event_type = 'signup' THEN 'not a date' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS date,
         CASE event_type WHEN 'view' THEN CAST(value AS VARCHAR) || ' C' WHEN 'click' THEN ''
              ELSE CAST(value AS VARCHAR) END AS temperature
  FROM events)
SELECT arrival_id, {time_text("TRY_CAST(date AS TIMESTAMP)")} AS date,
       {rounded("TRY_CAST(temperature AS DOUBLE)")} AS temperature FROM dirty"""
)
def clean_types(spark, sf_dir):
    return c.fix_types(dirty(spark, sf_dir))


RANGE_SQL = """CASE WHEN NOT (temperature BETWEEN
    CASE animal_type WHEN 'cattle' THEN 38.0 WHEN 'sheep' THEN 38.5 WHEN 'goat' THEN 38.5 ELSE 0 END
    AND CASE animal_type WHEN 'cattle' THEN 39.0 WHEN 'sheep' THEN 40.0 WHEN 'goat' THEN 40.5 ELSE 1 END)
    AND animal_type IS NOT NULL THEN 'extreme' END AS temperature_flag,
  CASE WHEN NOT (heart_rate BETWEEN
    CASE animal_type WHEN 'cattle' THEN 48 WHEN 'sheep' THEN 70 ELSE 0 END
    AND CASE animal_type WHEN 'cattle' THEN 84 WHEN 'sheep' THEN 80 ELSE 1 END)
    AND animal_type IS NOT NULL THEN 'extreme' END AS heart_rate_flag"""
CLIP_SQL = "CASE WHEN activity_level < 0.1e0 THEN 0.1e0 ELSE activity_level END"


@query(
    v.with_views(
        "metrics_raw livestock",
        f"""SELECT arrival_id, animal_type, {RANGE_SQL}
FROM metrics_raw LEFT JOIN livestock USING (tag_id)""",
    )
)
def clean_range_flags(spark, sf_dir):
    return c.flag_ranges(enriched(spark, sf_dir)).select(
        "arrival_id", "animal_type", "temperature_flag", "heart_rate_flag"
    )


@query(
    v.with_views("metrics_raw", f"SELECT arrival_id, {rounded(CLIP_SQL)} AS activity_level FROM metrics_raw")
)
def clean_clip(spark, sf_dir):
    return c.clip_activity(v.metrics_raw(spark, sf_dir)).select("arrival_id", "activity_level")


@query(
    v.with_views(
        "metrics_daily livestock",
        f"""WITH typed AS (SELECT * FROM metrics_daily LEFT JOIN livestock USING (tag_id)),
{FILL_SQL.format(source="typed")}, {IMPUTE_SQL},
kept AS (SELECT * FROM imputed QUALIFY row_number() OVER (PARTITION BY tag_id, date ORDER BY arrival_id) = 1)
SELECT arrival_id, tag_id, {day_text("date")} AS date, animal_type, {rounded("temperature")} AS temperature,
       {rounded("heart_rate")} AS heart_rate, {rounded(CLIP_SQL)} AS activity_level, {RANGE_SQL} FROM kept""",
    )
)
def clean_all(spark, sf_dir):
    readings = joins.with_animals(
        v.metrics_daily(spark, sf_dir), v.livestock(spark, sf_dir), columns=["animal_type"]
    )
    return c.clean(readings, keep=True)


@query(
    v.with_views(
        "metrics_raw",
        f"""WITH q AS (SELECT quantile_cont(heart_rate, 0.25) AS q1, quantile_cont(heart_rate, 0.75) AS q3
  FROM metrics_raw)
SELECT arrival_id, tag_id, {rounded("heart_rate")} AS heart_rate FROM metrics_raw, q
WHERE heart_rate < q1 - 1.5e0 * (q3 - q1) OR heart_rate > q3 + 1.5e0 * (q3 - q1)""",
    )
)
def iqr_outliers(spark, sf_dir):
    return c.iqr_outliers(v.metrics_raw(spark, sf_dir), "heart_rate").select("arrival_id", "tag_id", "heart_rate")


def _drift_sql(m: str) -> str:
    return f"""SELECT '{m}' AS "column", {rounded(
        f"greatest(abs(avg({m}) FILTER (new) - avg({m}) FILTER (NOT new)), "
        f"abs(stddev_samp({m}) FILTER (new) - stddev_samp({m}) FILTER (NOT new)))"
        f" / (stddev_samp({m}) FILTER (NOT new) + 1e-10)")} AS drift FROM parts"""


@query(
    v.with_views(
        "metrics_raw",
        "WITH parts AS (SELECT *, date >= TIMESTAMP '2024-01-16' AS new FROM metrics_raw) "
        + " UNION ALL ".join(_drift_sql(m) for m in METRICS),
    )
)
def data_drift(spark, sf_dir):
    readings = v.metrics_raw(spark, sf_dir)
    split = F.lit("2024-01-16").cast("timestamp_ntz")
    return stats.data_drift(readings.filter(F.col("date") < split), readings.filter(F.col("date") >= split), METRICS)


@query(
    v.with_views(
        "metrics_raw",
        " UNION ALL ".join(
            f"""SELECT '{m}' AS "column", {rounded(f"avg({m})")} AS mean, {rounded(f"stddev_samp({m})")} AS std_dev,
{rounded(f"min({m})")} AS min, {rounded(f"max({m})")} AS max, count({m}) AS non_null FROM metrics_raw"""
            for m in METRICS
        ),
    )
)
def describe_numeric(spark, sf_dir):
    return stats.describe_numeric(v.metrics_raw(spark, sf_dir), METRICS)


FINGERPRINT = f"""WITH d AS (SELECT CAST(concat('0x', substr(md5(concat_ws('|', coalesce(CAST(event_id AS VARCHAR), '~'),
    coalesce({time_text("ts")}, '~'), coalesce(CAST(user_id AS VARCHAR), '~'), coalesce(event_type, '~'),
    coalesce(CAST(value AS VARCHAR), '~'), coalesce(props, '~'))), 1, 15)) AS BIGINT) AS d FROM events)
SELECT count(*) AS row_count, bit_xor(d) AS xor_digest, CAST(sum(d) AS VARCHAR) AS sum_digest FROM d"""


@query(FINGERPRINT)
def table_fingerprint(spark, sf_dir):
    """Fingerprint of all columns of events; times as text of one format."""
    events = v.table(spark, sf_dir, "events")
    return stats.fingerprint(
        events.withColumn("ts", F.date_format("ts", TIME_FORMAT)), ["event_id", "ts", "user_id", "event_type", "value", "props"]
    )


@query(FINGERPRINT)
def whole_table_fingerprint(spark, sf_dir):
    return table_fingerprint(spark, sf_dir)


def _scaled(m: str, method: str) -> str:
    centre, scale = (f"avg({m})", f"stddev_pop({m})") if method == "standard" else (
        f"min({m})", f"max({m}) - min({m})")
    return f"{rounded(f'({m} - (SELECT {centre} FROM metrics_raw)) / (SELECT {scale} FROM metrics_raw)')}"


@query(
    v.with_views(
        "metrics_raw",
        "SELECT arrival_id, " + ", ".join(f"{_scaled(m, 'standard')} AS {m}_normalized" for m in METRICS)
        + " FROM metrics_raw",
    )
)
def normalize_standard(spark, sf_dir):
    return normalize.fit_transform(v.metrics_raw(spark, sf_dir), METRICS).select(
        "arrival_id", *[f"{m}_normalized" for m in METRICS]
    )


@query(
    v.with_views(
        "metrics_raw",
        "SELECT arrival_id, " + ", ".join(f"{_scaled(m, 'minmax')} AS {m}_normalized" for m in METRICS)
        + " FROM metrics_raw",
    )
)
def normalize_minmax(spark, sf_dir):
    return normalize.fit_transform(v.metrics_raw(spark, sf_dir), METRICS, "minmax").select(
        "arrival_id", *[f"{m}_normalized" for m in METRICS]
    )


@query(
    v.with_views(
        "metrics_raw",
        "SELECT arrival_id, " + ", ".join(f"{rounded(m)} AS {m}_original" for m in METRICS) + " FROM metrics_raw",
    )
)
def normalize_inverse(spark, sf_dir):
    readings = v.metrics_raw(spark, sf_dir)
    fitted = normalize.fit(readings, METRICS)
    scaled = normalize.transform(readings, fitted, METRICS).drop(*METRICS)
    return normalize.inverse_transform(scaled, fitted, METRICS).select(
        "arrival_id", *[f"{m}_original" for m in METRICS]
    )


_LOW = {"temperature": "CASE animal_type WHEN 'cattle' THEN 38.0e0 WHEN 'sheep' THEN 38.5e0 WHEN 'goat' THEN 38.5e0 ELSE 0 END",
        "heart_rate": "CASE animal_type WHEN 'cattle' THEN 48e0 WHEN 'sheep' THEN 70e0 ELSE 0 END"}
_HIGH = {"temperature": "CASE animal_type WHEN 'cattle' THEN 39.0e0 WHEN 'sheep' THEN 40.0e0 WHEN 'goat' THEN 40.5e0 ELSE 1 END",
         "heart_rate": "CASE animal_type WHEN 'cattle' THEN 84e0 WHEN 'sheep' THEN 80e0 ELSE 1 END"}


def _penalty(m: str, per: int) -> str:
    return (
        f"coalesce(CASE WHEN {m} < {_LOW[m]} OR {m} > {_HIGH[m]} "
        f"THEN {per} * least(abs({m} - {_LOW[m]}), abs({m} - {_HIGH[m]})) END, 0)"
    )


@query(
    v.with_views(
        "metrics_raw livestock",
        f"""SELECT arrival_id, {rounded(
            f"greatest(0, least(100, 100 - {_penalty('temperature', 5)} - {_penalty('heart_rate', 2)}"
            " - coalesce(10 * abs(activity_level - 1), 0)))")} AS health_score
FROM metrics_raw LEFT JOIN livestock USING (tag_id)""",
    )
)
def health_score(spark, sf_dir):
    return enriched(spark, sf_dir).select("arrival_id", s.health_score().alias("health_score"))


@query(
    v.with_views(
        "livestock",
        """SELECT tag_id, concat(farm_id, '_', CASE WHEN length(CAST(tag_id AS VARCHAR)) < 4
  THEN lpad(CAST(tag_id AS VARCHAR), 4, '0') ELSE CAST(tag_id AS VARCHAR) END) AS animal_id FROM livestock""",
    )
)
def animal_ids(spark, sf_dir):
    return v.livestock(spark, sf_dir).select("tag_id", s.animal_id("farm_id", "tag_id").alias("animal_id"))


@query(
    """SELECT o_orderkey, coalesce(start_date <= end_date AND start_date >= TIMESTAMP '2000-01-01'
         AND end_date <= TIMESTAMP '2000-06-30' + INTERVAL 365 DAY, false) AS valid
FROM (SELECT o_orderkey, TRY_CAST(CASE o_orderstatus WHEN 'P' THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END
               AS TIMESTAMP) AS start_date, o_orderdate + INTERVAL 30 DAY AS end_date FROM orders)"""
)
def date_range_check(spark, sf_dir):
    start = F.when(F.col("o_orderstatus") == "P", "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    end = F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"), "yyyy-MM-dd")
    return v.table(spark, sf_dir, "orders").select(
        "o_orderkey", s.valid_date_range(start, end, "2000-06-30 00:00:00").alias("valid")
    )
