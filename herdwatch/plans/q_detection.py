"""Queries: rolling z-scores, flags and outbreak clusters."""

from __future__ import annotations

from ..constants import METRICS
from ..operators import clusters as cl
from ..operators import detect as dt
from ..operators import joins
from . import views as v
from .registry import day_text, query, rounded, time_text

THRESHOLD = 1.5


def enriched(spark, sf_dir):
    """Readings with farm and animal type."""
    return joins.with_animals(v.metrics_raw(spark, sf_dir), v.livestock(spark, sf_dir))


def flagged(spark, sf_dir):
    """Enriched readings with z-scores and flags; the join comes after the flags are known."""
    found = dt.detect_statistical(
        v.metrics_raw(spark, sf_dir), threshold=THRESHOLD, order_by=("date", "arrival_id")
    )
    return joins.with_animals(found, v.livestock(spark, sf_dir))


def _z(m: str) -> str:
    frame = "(PARTITION BY tag_id ORDER BY date, arrival_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
    return (
        f"CASE WHEN stddev_samp({m}) OVER {frame} > 1e-9 THEN "
        f"({m} - avg({m}) OVER {frame}) / stddev_samp({m}) OVER {frame} END AS {m}_zscore"
    )


Z_SQL = f"""scored AS (
  SELECT *, {", ".join(_z(m) for m in METRICS)} FROM metrics_raw),
flagged AS (
  SELECT *, {", ".join(f"coalesce(abs({m}_zscore) > {THRESHOLD}e0 + 1e-9, false) AS {m}_anomaly" for m in METRICS)},
         {" OR ".join(f"coalesce(abs({m}_zscore) > {THRESHOLD}e0 + 1e-9, false)" for m in METRICS)} AS is_anomaly,
         greatest({", ".join(f"abs({m}_zscore)" for m in METRICS)}) AS anomaly_score
  FROM scored),
enriched AS (
  SELECT f.*, l.animal_type, l.farm_id FROM flagged f LEFT JOIN livestock l USING (tag_id))"""

CLUSTER_SQL = f"""clusters AS (
  SELECT farm_id, time_bucket(INTERVAL 7 DAY, date, TIMESTAMP '1970-01-01') AS start_date,
         count(*) AS anomaly_rows, count(DISTINCT tag_id) AS affected_animals,
         avg(anomaly_score) AS avg_anomaly_score,
         array_to_string(list_sort(list(DISTINCT animal_type)), ',') AS animal_types,
         concat_ws(',', {", ".join(f"CASE WHEN bool_or({m}_anomaly) THEN '{m}' END" for m in METRICS)})
           AS metrics_affected
  FROM enriched WHERE is_anomaly AND farm_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3)"""

SEVERITY_SQL = """CASE WHEN affected_animals >= 10 OR avg_anomaly_score >= 7 THEN 'critical'
            WHEN affected_animals >= 5 OR avg_anomaly_score >= 5 THEN 'high'
            WHEN affected_animals >= 3 OR avg_anomaly_score >= 3 THEN 'medium' ELSE 'low' END"""


@query(
    v.with_views(
        "livestock metrics_raw",
        f"""WITH {Z_SQL}, {CLUSTER_SQL}
SELECT farm_id, {time_text("start_date")} AS start_date,
       {time_text("start_date + INTERVAL 7 DAY")} AS end_date, anomaly_rows, affected_animals,
       {rounded("avg_anomaly_score")} AS avg_anomaly_score, animal_types, metrics_affected,
       {SEVERITY_SQL} AS severity
FROM clusters""",
    )
)
def outbreak_clusters(spark, sf_dir):
    return cl.with_severity(cl.detect_clusters(flagged(spark, sf_dir)))


@query(
    v.with_views(
        "metrics_raw",
        f"""WITH scored AS (SELECT *, {", ".join(_z(m) for m in METRICS)} FROM metrics_raw)
SELECT arrival_id, tag_id, {", ".join(f'{rounded(f"{m}_zscore")} AS {m}_zscore' for m in METRICS)}
FROM scored""",
    )
)
def rolling_zscore(spark, sf_dir):
    scored = dt.rolling_zscore(v.metrics_raw(spark, sf_dir), order_by=("date", "arrival_id"))
    return scored.select("arrival_id", "tag_id", *[f"{m}_zscore" for m in METRICS])


@query(
    v.with_views(
        "livestock metrics_raw",
        f"""WITH {Z_SQL}
SELECT arrival_id, tag_id, farm_id, animal_type, {", ".join(f"{m}_anomaly" for m in METRICS)}, is_anomaly,
       {rounded("anomaly_score")} AS anomaly_score FROM enriched""",
    )
)
def statistical_flags(spark, sf_dir):
    return flagged(spark, sf_dir).select(
        "arrival_id", "tag_id", "farm_id", "animal_type", *[f"{m}_anomaly" for m in METRICS],
        "is_anomaly", "anomaly_score",
    )


@query(
    v.with_views(
        "livestock metrics_raw",
        f"""WITH {Z_SQL}
SELECT farm_id, {day_text("date")} AS start_date, {day_text("date")} AS end_date,
       count(*) AS anomaly_rows, count(DISTINCT tag_id) AS affected_animals,
       {rounded("avg(anomaly_score)")} AS avg_anomaly_score,
       array_to_string(list_sort(list(DISTINCT animal_type)), ',') AS animal_types,
       'statistical' AS detection_method
FROM enriched WHERE is_anomaly AND farm_id IS NOT NULL
GROUP BY farm_id, {day_text("date")} HAVING count(*) >= 3""",
    )
)
def basic_clusters_daily(spark, sf_dir):
    return cl.detect_clusters_daily(flagged(spark, sf_dir))


@query(
    v.with_views(
        "livestock metrics_raw",
        f"""WITH {Z_SQL}, {CLUSTER_SQL}
SELECT {time_text("start_date")} AS start_date, {time_text("start_date + INTERVAL 7 DAY")} AS end_date,
       row_number() OVER (ORDER BY start_date, farm_id) - 1 AS position,
       'Farm ' || farm_id || ': ' || affected_animals || ' animals' AS label,
       CASE WHEN {SEVERITY_SQL} = 'critical' THEN 'red' ELSE 'orange' END AS colour
FROM clusters""",
    )
)
def cluster_timeline(spark, sf_dir):
    return cl.timeline_rows(cl.with_severity(cl.detect_clusters(flagged(spark, sf_dir))))
