"""Outbreak clusters: flagged readings grouped by farm and time window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import METRICS


def severity(animals: Column, score: Column) -> Column:
    """critical / high / medium / low by number of animals or mean score."""
    score = F.coalesce(score, F.lit(0.0))
    return (
        F.when((animals >= 10) | (score >= 7.0), "critical")
        .when((animals >= 5) | (score >= 5.0), "high")
        .when((animals >= 3) | (score >= 3.0), "medium")
        .otherwise("low")
    )


def cluster_score(mean_score: Column, methods: Column) -> Column:
    """Mean score weighted by the share of methods that found the cluster, at most 10."""
    return F.least(F.lit(10.0), mean_score * methods / 2.0)


def _aggregates(df: DataFrame, score: str) -> list[Column]:
    aggs = [
        F.count(F.lit(1)).alias("anomaly_rows"),
        F.count_distinct("tag_id").alias("affected_animals"),
        F.avg(score).alias("avg_anomaly_score"),
    ]
    if "animal_type" in df.columns:
        aggs.append(F.array_sort(F.collect_set("animal_type")).alias("animal_types"))
    return aggs


def affected_metrics(metrics: Sequence[str], columns: Sequence[str]) -> Column:
    """Metrics with at least one flag in the group, in the order given."""
    present = [m for m in metrics if f"{m}_anomaly" in columns]
    if not present:
        return F.expr("CAST(array() AS ARRAY<STRING>)")
    return F.array_compact(F.array(*[F.when(F.bool_or(f"{m}_anomaly"), F.lit(m)) for m in present]))


def detect_clusters(
    df: DataFrame,
    *,
    window: str = "7 days",
    min_cluster_size: int = 3,
    flag: str = "is_anomaly",
    score: str = "anomaly_score",
    metrics: Sequence[str] = METRICS,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Groups of at least ``min_cluster_size`` flagged rows per farm and epoch-aligned window.

    Only flagged rows are shuffled, and already combined per (farm, window, animal) on the
    map side, so a farm that holds most of the rows costs no more than its animals.
    """
    return (
        df.filter(F.col(flag) & F.col("farm_id").isNotNull())
        .groupBy("farm_id", F.window("date", window).alias("_w"))
        .agg(*_aggregates(df, score), affected_metrics(metrics, df.columns).alias("metrics_affected"), *extra)
        .filter(F.col("anomaly_rows") >= min_cluster_size)
        .withColumns({"start_date": F.col("_w.start"), "end_date": F.col("_w.end")})
        .drop("_w")
    )


def detect_clusters_daily(
    df: DataFrame, *, min_cluster_size: int = 3, method: str = "statistical"
) -> DataFrame:
    """The plain variant: one cluster per farm and day."""
    return (
        df.filter(F.col("is_anomaly") & F.col("farm_id").isNotNull())
        .groupBy("farm_id", F.to_date("date").alias("start_date"))
        .agg(*_aggregates(df, "anomaly_score"))
        .filter(F.col("anomaly_rows") >= min_cluster_size)
        .withColumns({"end_date": F.col("start_date"), "detection_method": F.lit(method)})
    )


def with_severity(clusters: DataFrame) -> DataFrame:
    return clusters.withColumn("severity", severity(F.col("affected_animals"), F.col("avg_anomaly_score")))


def merge_clusters(*found: DataFrame, min_cluster_size: int = 3, max_features: int = 5) -> DataFrame:
    """Merge the clusters of several methods that share farm, start day and end day.

    Each input has columns farm_id, start_date, end_date, affected_animals,
    avg_anomaly_score, animal_types, detection_method and features (array, may be empty).
    """
    columns = ["farm_id", "start_date", "end_date", "affected_animals", "avg_anomaly_score",
               "animal_types", "detection_method", "features"]
    everything = found[0].select(*columns)
    for other in found[1:]:
        everything = everything.unionByName(other.select(*columns))
    merged = everything.groupBy(
        "farm_id", F.to_date("start_date").alias("start_day"), F.to_date("end_date").alias("end_day")
    ).agg(
        F.min("start_date").alias("start_date"),
        F.min("end_date").alias("end_date"),
        F.max("affected_animals").alias("affected_animals"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("animal_types")))).alias("animal_types"),
        F.array_sort(F.collect_set("detection_method")).alias("detection_methods"),
        F.avg("avg_anomaly_score").alias("avg_anomaly_score"),
        F.slice(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("features")))), 1, max_features
        ).alias("features_contributing"),
    )
    return (
        merged.filter(F.col("affected_animals") >= min_cluster_size)
        .withColumn(
            "ensemble_score",
            F.coalesce(cluster_score(F.col("avg_anomaly_score"), F.size("detection_methods")), F.lit(0.0)),
        )
        .transform(with_severity)
        .drop("start_day", "end_day")
    )


def timeline_rows(clusters: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Start, end, position, label and colour of each cluster, oldest first."""
    from .order_stats import number_rows

    numbered = number_rows(clusters, ["start_date", "farm_id"], "position", max_rows=max_rows)
    return numbered.select(
        "start_date", "end_date", "position",
        F.format_string(
            "Farm %s: %d animals", F.col("farm_id").cast("string"), F.col("affected_animals")
        ).alias("label"),
        F.when(F.col("severity") == "critical", "red").otherwise("orange").alias("colour"),
    )
