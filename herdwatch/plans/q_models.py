"""Queries: seasonal decomposition, isolation forest, ensemble."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import METRICS, DetectionSettings
from ..operators import ensemble as en
from ..operators import iforest, joins, seasonal, stats
from . import views as v
from .q_detection import enriched
from .registry import day_text, query, rounded

SETTINGS = DetectionSettings(threshold=1.5)


def _components(model: str) -> str:
    minus = "-" if model == "additive" else "/"
    return f"""spans AS (SELECT tag_id, min(day) AS lo, max(day) AS hi FROM series_daily GROUP BY tag_id),
cal AS (SELECT tag_id, lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day,
               date_diff('day', lo, hi) + 1 AS n FROM spans),
reg AS (SELECT c.tag_id, c.day, c.n, date_diff('day', c.lo, c.day) AS i, s.value IS NOT NULL AS given,
               last_value(s.value IGNORE NULLS) OVER (PARTITION BY c.tag_id ORDER BY c.day
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x
        FROM cal c LEFT JOIN series_daily s ON s.tag_id = c.tag_id AND s.day = c.day),
ma AS (SELECT *, CASE WHEN i >= 3 AND i <= n - 4 AND n >= 14 THEN avg(x) OVER (PARTITION BY tag_id ORDER BY i
                 ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS t FROM reg),
fits AS (SELECT tag_id, regr_slope(t, i) FILTER (i >= 3 AND i < least(10, n - 4)) AS hs,
                regr_intercept(t, i) FILTER (i >= 3 AND i < least(10, n - 4)) AS hb,
                regr_slope(t, i) FILTER (i >= greatest(3, n - 11) AND i < n - 4) AS ts,
                regr_intercept(t, i) FILTER (i >= greatest(3, n - 11) AND i < n - 4) AS tb
         FROM ma WHERE t IS NOT NULL GROUP BY tag_id),
tr AS (SELECT ma.*, CASE WHEN n < 14 THEN NULL WHEN i < 3 THEN hs * i + hb WHEN i > n - 4 THEN ts * i + tb ELSE t END
              AS trend FROM ma LEFT JOIN fits USING (tag_id)),
det AS (SELECT *, x {minus} trend AS d FROM tr),
phases AS (SELECT tag_id, i % 7 AS phase, avg(d) AS m FROM det GROUP BY 1, 2),
centres AS (SELECT tag_id, avg(m) AS c FROM phases GROUP BY 1),
parts AS (SELECT det.*, m {minus} c AS seasonal, x {minus} trend {minus} (m {minus} c) AS residual
          FROM det JOIN phases ON phases.tag_id = det.tag_id AND phase = i % 7
               JOIN centres ON centres.tag_id = det.tag_id)"""


PARTS = f"""SELECT tag_id, {day_text("day")} AS day, {rounded("x")} AS observed, {rounded("trend")} AS trend,
       {rounded("seasonal")} AS seasonal, {rounded("residual")} AS residual FROM parts"""


@query(v.with_views("series_daily", f"WITH {_components('additive')} {PARTS}"))
def seasonal_decompose(spark, sf_dir):
    return seasonal.decompose(v.series_daily(spark, sf_dir), "value", ["tag_id"])


@query(v.with_views("series_daily", f"WITH {_components('multiplicative')} {PARTS}"))
def seasonal_decompose_multiplicative(spark, sf_dir):
    return seasonal.decompose(v.series_daily(spark, sf_dir), "value", ["tag_id"], model="multiplicative")


@query(
    v.with_views(
        "series_daily",
        f"""WITH {_components("additive")}, sizes AS (SELECT tag_id, count(*) AS rows FROM series_daily GROUP BY 1)
SELECT p.tag_id, {day_text("p.day")} AS day, {rounded("x")} AS value,
       {rounded("CASE WHEN rows < 14 THEN x ELSE x - seasonal END")} AS value_seasonal_adj
FROM parts p JOIN sizes USING (tag_id) WHERE given""",
    )
)
def seasonal_adjust(spark, sf_dir):
    return seasonal.adjust(v.series_daily(spark, sf_dir), "value", ["tag_id"])


@query(
    v.with_views(
        "series_daily",
        f"""WITH {_components("additive")}, spread AS (
  SELECT tag_id, avg(residual) AS m, stddev_samp(residual) AS s FROM parts GROUP BY 1)
SELECT p.tag_id, {day_text("p.day")} AS day, {rounded("x")} AS value, {rounded("residual")} AS residual,
       {rounded("CASE WHEN s > 1e-9 THEN (residual - m) / s END")} AS residual_zscore,
       coalesce(abs((residual - m) / CASE WHEN s > 1e-9 THEN s END) > 2, false) AS value_seasonal_anomaly
FROM parts p JOIN spread USING (tag_id) WHERE given""",
    )
)
def seasonal_anomalies(spark, sf_dir):
    return seasonal.detect_seasonal(v.series_daily(spark, sf_dir), "value", 2.0, ["tag_id"])


def ensemble(spark, sf_dir):
    found = en.detect_ensemble(
        v.metrics_raw(spark, sf_dir), METRICS, ["arrival_id"], settings=SETTINGS, order_by=("date", "arrival_id")
    )
    return joins.with_animals(found, v.livestock(spark, sf_dir))


@query()
def iforest_scores(spark, sf_dir):
    found = iforest.detect(v.metrics_raw(spark, sf_dir), METRICS, ["arrival_id"])
    return found.select(
        "arrival_id", "if_anomaly", "if_anomaly_score", *[f"{m}_if_contribution" for m in METRICS]
    )


@query()
def iforest_clusters(spark, sf_dir):
    return iforest.detect_forest_clusters(
        iforest.detect(enriched(spark, sf_dir), METRICS, ["arrival_id"]), METRICS
    )


@query()
def ensemble_scores(spark, sf_dir):
    return ensemble(spark, sf_dir).select(
        "arrival_id", "stat_is_anomaly", "stat_anomaly_score", "if_anomaly", "if_anomaly_score",
        "ensemble_anomaly", "ensemble_anomaly_score", "is_anomaly", "anomaly_score", "detection_method",
    )


@query()
def ensemble_clusters(spark, sf_dir):
    return en.detect_ensemble_clusters(ensemble(spark, sf_dir))


@query()
def method_distribution(spark, sf_dir):
    return stats.counts_by(ensemble(spark, sf_dir), "detection_method")


@query()
def top_features(spark, sf_dir):
    found = iforest.detect(enriched(spark, sf_dir), METRICS, ["arrival_id"])
    return (
        found.filter("if_anomaly")
        .groupBy("animal_type")
        .agg(F.count("*").alias("anomalies"), iforest.top_features(METRICS, found.columns).alias("top_features"))
    )


# The combination step alone, over scores that SQL can compute as well.
@query(
    v.with_views(
        "metrics_raw",
        f"""WITH scored AS (
  SELECT arrival_id, heart_rate > 60 AS stat_is_anomaly, heart_rate / 100 AS stat_anomaly_score,
         value > 40 AS if_anomaly, least(10, value / 10) AS if_anomaly_score FROM metrics_raw),
e AS (SELECT *, 0.4e0 * 10 * stat_anomaly_score / (SELECT max(stat_anomaly_score) FROM scored)
              + 0.6e0 * if_anomaly_score AS s FROM (
        SELECT * REPLACE (coalesce(stat_is_anomaly, false) AS stat_is_anomaly) FROM scored))
SELECT arrival_id, {rounded("s")} AS ensemble_anomaly_score, coalesce(s >= 5, false) AS ensemble_anomaly,
       stat_is_anomaly OR if_anomaly OR coalesce(s >= 5, false) AS is_anomaly,
       {rounded("greatest(CAST(stat_is_anomaly AS INT), CAST(if_anomaly AS INT), s)")} AS anomaly_score,
       coalesce(nullif(concat_ws('+', CASE WHEN stat_is_anomaly THEN 'statistical' END,
         CASE WHEN if_anomaly THEN 'isolation_forest' END, CASE WHEN s >= 5 THEN 'ensemble' END), ''), 'none')
         AS detection_method FROM e""",
    )
)
def ensemble_combination(spark, sf_dir):
    scored = v.metrics_raw(spark, sf_dir).select(
        "arrival_id",
        F.coalesce(F.col("heart_rate") > 60, F.lit(False)).alias("stat_is_anomaly"),
        (F.col("heart_rate") / 100).alias("stat_anomaly_score"),
        (F.col("value") > 40).alias("if_anomaly"),
        F.least(F.lit(10.0), F.col("value") / 10).alias("if_anomaly_score"),
    )
    return en.combine(scored).select(
        "arrival_id", "ensemble_anomaly_score", "ensemble_anomaly", "is_anomaly", "anomaly_score",
        "detection_method",
    )
