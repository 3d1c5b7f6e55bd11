"""Queries: data-quality analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import METRICS
from ..operators import joins, quality
from . import views as v
from .registry import query, rounded

AS_OF = f"TIMESTAMP '{v.QUALITY_AS_OF}'"
COLUMNS = ("tag_id", "date", "animal_type", *METRICS)


def readings(spark, sf_dir):
    rows = joins.with_animals(v.metrics_daily(spark, sf_dir), v.livestock(spark, sf_dir), ["animal_type"])
    return rows.select(*COLUMNS)


R = f"r AS (SELECT {', '.join(COLUMNS)} FROM metrics_daily LEFT JOIN livestock USING (tag_id))"
RANGES = {"temperature": "35 AND 42", "heart_rate": "40 AND 120", "activity_level": "0.1e0 AND 2"}


def valid(c: str) -> str:
    return f"count(*) FILTER ({c} BETWEEN {RANGES[c]})" if c in RANGES else f"count({c})"


PRESENT = " + ".join(f"count({c})" for c in COLUMNS)
VALID = " + ".join(valid(c) for c in COLUMNS)
N = len(COLUMNS)


@query(
    v.with_views(
        "metrics_daily livestock",
        f"""WITH {R}, g AS (SELECT tag_id, count(*) AS n FROM r GROUP BY tag_id)
SELECT (SELECT count(*) FROM r) AS total_records, count(*) AS unique_animals,
       (SELECT strftime(min(date), '%Y-%m-%d') FROM r) AS first_date,
       (SELECT strftime(max(date), '%Y-%m-%d') FROM r) AS last_date,
       (SELECT date_diff('day', min(date), max(date)) + 1 FROM r) AS days,
       min(n) AS records_min, max(n) AS records_max, {rounded("avg(n)")} AS records_mean,
       {rounded("median(n)")} AS records_median FROM g""",
    )
)
def dq_basic(spark, sf_dir):
    return quality.basic_stats(readings(spark, sf_dir))


@query(
    v.with_views(
        "metrics_daily livestock",
        f"WITH {R} SELECT animal_type, count(*) AS records FROM r WHERE animal_type IS NOT NULL GROUP BY animal_type",
    )
)
def dq_type_counts(spark, sf_dir):
    return quality.type_counts(readings(spark, sf_dir))


@query(
    v.with_views(
        "metrics_daily livestock",
        f"WITH {R} "
        + " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", {rounded(f"count({c}) * 100e0 / count(*)")} AS complete_pct,
count(*) - count({c}) AS missing_count, {rounded(f"(count(*) - count({c})) * 100e0 / count(*)")} AS missing_pct,
{"true" if c in ("tag_id", "date", "animal_type") else "false"} AS critical FROM r"""
            for c in COLUMNS
        )
        + f""" UNION ALL SELECT '*', {rounded(f"({PRESENT}) * 100e0 / ({N} * count(*))")},
{N} * count(*) - ({PRESENT}), {rounded(f"100 - ({PRESENT}) * 100e0 / ({N} * count(*))")}, false FROM r""",
    )
)
def dq_completeness(spark, sf_dir):
    return quality.completeness(readings(spark, sf_dir))


@query(
    v.with_views(
        "metrics_daily livestock",
        f"WITH {R} "
        + " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", {rounded(f"{valid(c)} * 100e0 / count(*)")} AS valid_pct,
{f"count(*) - {valid(c)}" if c in RANGES else "NULL::BIGINT"} AS invalid_count,
{rounded(f"(count(*) - {valid(c)}) * 100e0 / count(*)") if c in RANGES else "NULL::DOUBLE"} AS invalid_pct FROM r"""
            for c in COLUMNS
        )
        + f""" UNION ALL SELECT '*', {rounded(f"({VALID}) * 100e0 / ({N} * count(*))")}, NULL, NULL FROM r""",
    )
)
def dq_validity(spark, sf_dir):
    return quality.validity(readings(spark, sf_dir))


DUPLICATES = """dup AS (SELECT coalesce(sum(n) FILTER (n > 1), 0) * 100e0 / sum(n) AS pct,
  CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM r GROUP BY tag_id, date))"""


@query(
    v.with_views(
        "metrics_daily livestock",
        f"""WITH {R}, {DUPLICATES}
SELECT rows AS duplicate_rows, {rounded("pct")} AS duplicate_pct, {rounded("greatest(0, 100 - 2 * pct)")} AS score
FROM dup""",
    )
)
def dq_duplicates(spark, sf_dir):
    return quality.duplicates(readings(spark, sf_dir))


@query(
    v.with_views(
        "herd_daily",
        """SELECT farm_id AS tag_id, count(DISTINCT animal_type) AS types FROM herd_daily
GROUP BY farm_id HAVING count(DISTINCT animal_type) > 1""",
    )
)
def dq_type_conflict(spark, sf_dir):
    return quality.type_conflicts(v.herd_daily(spark, sf_dir).withColumnRenamed("farm_id", "tag_id"))


@query(
    """SELECT tag_id, count(*) AS readings, count(*) FILTER (back) AS steps_back FROM (
  SELECT o_custkey AS tag_id, coalesce(o_orderdate < lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey),
         false) AS back FROM orders)
GROUP BY tag_id HAVING count(*) > 1 AND count(*) FILTER (back) > 0"""
)
def dq_date_order(spark, sf_dir):
    arriving = v.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("tag_id"), F.col("o_orderdate").alias("date"),
        F.col("o_orderkey").alias("arrival_id"),
    )
    return quality.date_disorder(arriving)


GAPS = """gaps AS (SELECT tag_id, avg(gap) AS gap FROM (
  SELECT tag_id, date_diff('day', lag(date) OVER (PARTITION BY tag_id ORDER BY date), date) AS gap FROM r)
  GROUP BY tag_id HAVING avg(gap) IS NOT NULL)"""


@query(
    v.with_views(
        "metrics_daily livestock",
        f"""WITH {R}, {GAPS}
SELECT {rounded("avg(gap)")} AS mean_days_between, {rounded("median(gap)")} AS median_days_between,
       avg(gap) <= 3 AS consistent FROM gaps""",
    )
)
def dq_update_frequency(spark, sf_dir):
    return quality.update_frequency(readings(spark, sf_dir))


TIMELINESS = f"""timely AS (
  SELECT latest_date, days_old, mean_days, recency, frequency, recency * 0.7e0 + frequency * 0.3e0 AS timeliness
  FROM (SELECT *, CASE WHEN days_old <= 7 THEN 100e0 WHEN days_old <= 30 THEN 70 WHEN days_old <= 90 THEN 40
                  ELSE 10 END AS recency,
               CASE WHEN mean_days IS NULL THEN 50e0 WHEN mean_days <= 1 THEN 100 WHEN mean_days <= 3 THEN 80
                    WHEN mean_days <= 7 THEN 60 ELSE 30 END AS frequency
        FROM (SELECT strftime(max(date), '%Y-%m-%d') AS latest_date,
                     datesub('day', CAST(max(date) AS TIMESTAMP), {AS_OF}) AS days_old,
                     (SELECT avg(gap) FROM gaps) AS mean_days FROM r)))"""


@query(
    v.with_views(
        "metrics_daily livestock",
        f"""WITH {R}, {GAPS}, {TIMELINESS}
SELECT latest_date, days_old, {rounded("mean_days")} AS mean_days_between, days_old <= 7 AS is_recent,
       {rounded("recency")} AS recency_score, {rounded("frequency")} AS frequency_score,
       {rounded("timeliness")} AS timeliness FROM timely""",
    )
)
def dq_timeliness(spark, sf_dir):
    return quality.timeliness(readings(spark, sf_dir), v.QUALITY_AS_OF)


MEASURES = f"""{R}, {DUPLICATES}, {GAPS}, {TIMELINESS},
dims AS (SELECT ({PRESENT}) * 100e0 / ({N} * count(*)) AS completeness,
                ({VALID}) * 100e0 / ({N} * count(*)) AS validity,
                (SELECT greatest(0, 100 - 2 * pct) FROM dup) AS consistency,
                (SELECT timeliness FROM timely) AS timeliness FROM r),
m AS (SELECT *, least(100, greatest(0, 0.3e0 * completeness + 0.3e0 * validity + 0.2e0 * consistency
                                       + 0.2e0 * timeliness)) AS score FROM dims)"""


@query(
    v.with_views(
        "metrics_daily livestock",
        f"""WITH {MEASURES}
SELECT {rounded("completeness")} AS completeness, {rounded("validity")} AS validity,
       {rounded("consistency")} AS consistency, {rounded("timeliness")} AS timeliness,
       {rounded("score")} AS quality_score,
       CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 70 THEN 'Good' WHEN score >= 50 THEN 'Fair'
            WHEN score >= 30 THEN 'Poor' ELSE 'Very Poor' END AS rating,
       CASE WHEN score >= 90 THEN 5 WHEN score >= 70 THEN 4 WHEN score >= 50 THEN 3
            WHEN score >= 30 THEN 2 ELSE 1 END AS level
FROM m""",
    )
)
def dq_score(spark, sf_dir):
    return quality.score(quality.measures(readings(spark, sf_dir), v.QUALITY_AS_OF))


ISSUES = """issues AS (
  SELECT 'completeness' AS type, CASE WHEN completeness < 70 THEN 'high' ELSE 'medium' END AS severity,
         printf('Data completeness is %.1f%%', completeness) AS message FROM m WHERE completeness < 90
  UNION ALL SELECT 'validity', CASE WHEN validity < 70 THEN 'high' ELSE 'medium' END,
         printf('Data validity is %.1f%%', validity) FROM m WHERE validity < 90
  UNION ALL SELECT 'duplicates', CASE WHEN pct < 20 THEN 'medium' ELSE 'high' END,
         printf('%.1f%% of records are duplicates', pct) FROM dup WHERE pct > 5
  UNION ALL SELECT 'stale_data', CASE WHEN days_old > 90 THEN 'high' ELSE 'medium' END,
         'Data is ' || days_old || ' days old' FROM timely WHERE days_old > 30)"""


@query(
    v.with_views(
        "metrics_daily livestock",
        f"""WITH {MEASURES}, {ISSUES} SELECT *, NULL::VARCHAR AS "column" FROM issues""",
    )
)
def dq_issues(spark, sf_dir):
    return quality.issues(quality.measures(readings(spark, sf_dir), v.QUALITY_AS_OF))


@query(
    v.with_views(
        "metrics_daily livestock",
        f"""WITH {MEASURES}, {ISSUES}
SELECT type AS issue, severity AS priority, CASE type
    WHEN 'completeness' THEN 'Add missing values or collect more complete data'
    WHEN 'validity' THEN 'Review data collection procedures and validate sensor readings'
    WHEN 'duplicates' THEN 'Remove or merge duplicate records'
    ELSE 'Collect more recent data for accurate analysis' END AS recommendation, message AS details
FROM issues
UNION ALL
SELECT 'general', CASE WHEN score >= 90 THEN 'low' WHEN score >= 70 THEN 'medium' ELSE 'high' END,
    CASE WHEN score >= 90 THEN 'Data quality is excellent. Continue current practices.'
         WHEN score >= 70 THEN 'Data quality is good but could be improved.'
         ELSE 'Data quality needs significant improvement before analysis.' END,
    printf('Quality score: %.1f%%', score) FROM m""",
    )
)
def dq_recommendations(spark, sf_dir):
    return quality.recommendations(quality.measures(readings(spark, sf_dir), v.QUALITY_AS_OF))


@query(
    v.with_views(
        "metrics_daily livestock",
        f"""WITH {R}, {DUPLICATES}, found AS ("""
        + " UNION ALL ".join(
            f"""SELECT 'missing' AS "check", '{c}' AS "column", count(*) - count({c}) AS count,
{rounded(f"(count(*) - count({c})) * 100e0 / count(*)")} AS pct FROM r"""
            for c in COLUMNS
        )
        + f""" UNION ALL SELECT 'duplicates', NULL, rows, {rounded("pct")} FROM dup
UNION ALL SELECT 'out_of_range', 'temperature', count(*) FILTER (NOT temperature BETWEEN 35 AND 42), NULL FROM r
UNION ALL SELECT 'out_of_range', 'heart_rate', count(*) FILTER (NOT heart_rate BETWEEN 40 AND 120), NULL FROM r)
SELECT * FROM found WHERE count > 0
UNION ALL SELECT 'days_old', 'date', datesub('day', CAST(max(date) AS TIMESTAMP), {AS_OF}), NULL FROM r""",
    )
)
def dq_quick_check(spark, sf_dir):
    return quality.quick_check(readings(spark, sf_dir), v.QUALITY_AS_OF)
