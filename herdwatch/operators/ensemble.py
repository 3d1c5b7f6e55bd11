"""Ensemble of rolling z-scores and isolation forest, and the detector picked by settings."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ENSEMBLE_THRESHOLD, ENSEMBLE_WEIGHTS, METRICS, DetectionSettings
from . import iforest
from .clean import fix_types
from .clusters import detect_clusters, detect_clusters_daily, merge_clusters
from .detect import detect_statistical

STAT, FOREST = "statistical", "isolation_forest"


def combine(df: DataFrame, weights: dict[str, float] = ENSEMBLE_WEIGHTS, threshold: float = ENSEMBLE_THRESHOLD, top: Column | None = None) -> DataFrame:
    """Weighted score, flag, combined flag and score, and the methods that fired.

    Expects stat_is_anomaly, stat_anomaly_score, if_anomaly and if_anomaly_score. ``top`` is the greatest
    stat_anomaly_score, where it is known; else it is computed.
    """
    top = df.agg(F.max("stat_anomaly_score")).scalar() if top is None else top
    scaled = F.when(F.coalesce(top, F.lit(0.0)) > 0, 10 * F.col("stat_anomaly_score") / top).otherwise(0.0)
    scored = df.withColumn(
        "ensemble_anomaly_score", weights[STAT] * scaled + weights[FOREST] * F.col("if_anomaly_score")
    ).withColumn("ensemble_anomaly", F.coalesce(F.col("ensemble_anomaly_score") >= threshold, F.lit(False)))
    flags = ("stat_is_anomaly", "if_anomaly", "ensemble_anomaly")
    methods = F.concat_ws(
        "+",
        F.when(F.col("stat_is_anomaly"), STAT),
        F.when(F.col("if_anomaly"), FOREST),
        F.when(F.col("ensemble_anomaly"), "ensemble"),
    )
    return scored.withColumns(
        {
            "is_anomaly": F.col(flags[0]) | F.col(flags[1]) | F.col(flags[2]),
            "anomaly_score": F.greatest(
                *[F.col(f).cast("int").cast("double") for f in flags], F.col("ensemble_anomaly_score")
            ),
            "detection_method": F.when(methods == "", "none").otherwise(methods),
        }
    )


def detect_ensemble(
    df: DataFrame, metrics: Sequence[str] = METRICS, ids: Sequence[str] = ("arrival_id",), *,
    settings: DetectionSettings = DetectionSettings(), partition_by: Sequence[str] = ("tag_id",),
    order_by: Sequence[str] = ("date",), hot_key_rows: int | None = None, forest: iforest.Forest | None = None,
) -> DataFrame:
    """Both detectors on one table, side by side in the same rows (no join), then combined."""
    present = [m for m in metrics if m in df.columns]
    df = fix_types(df, numeric=present)
    stat = detect_statistical(
        df, present, threshold=settings.threshold, window_size=settings.window_size, partition_by=partition_by,
        order_by=order_by, hot_key_rows=hot_key_rows,
    )
    stat = stat.withColumnsRenamed(
        {"is_anomaly": "stat_is_anomaly", "anomaly_score": "stat_anomaly_score"}
    ).drop(*[f"{m}_anomaly" for m in present])
    if forest is not None:
        return combine(iforest.apply_to_training(stat, forest), settings.ensemble_weights)
    grown = iforest.grow(
        df, present, ids, trees=settings.n_estimators, sample_size=settings.max_samples,
        contamination=settings.contamination, seed=settings.random_state,
    )
    # Windows and scores are computed once, and what the combination must know of all rows comes with them.
    top = F.max("stat_anomaly_score").alias("_top")
    forest, kept, seen = iforest.score_once(stat, grown, max_rows=hot_key_rows, observed=[top])
    return combine(iforest.apply_to_training(kept, forest), settings.ensemble_weights, top=F.lit(seen["_top"]).cast("double"))


def detect_ensemble_clusters(
    df: DataFrame, metrics: Sequence[str] = METRICS, *, window: str = "7 days", min_cluster_size: int = 3
) -> DataFrame:
    """Clusters by the combined flag and by the forest's flag, merged by farm and window."""
    has_types = "animal_type" in df.columns

    def figures(flag: str, score: str, tag: str) -> list:
        on = F.col(flag)
        types = F.when(on, F.col("animal_type")) if has_types else F.lit(None).cast("string")
        return [
            F.count_if(on).alias(f"rows_{tag}"),
            F.count_distinct(F.when(on, F.col("tag_id"))).alias(f"animals_{tag}"),
            F.avg(F.when(on, F.col(score))).alias(f"score_{tag}"),
            F.array_sort(F.collect_set(types)).alias(f"types_{tag}"),
        ]

    shares = [m for m in metrics if f"{m}_if_contribution" in df.columns]
    only_forest = df.withColumns(
        {f"{m}_if_contribution": F.when(F.col("if_anomaly"), F.col(f"{m}_if_contribution")) for m in shares}
    )
    # Both kinds of cluster come from one pass over the flagged rows.
    groups = (
        only_forest.filter((F.col("is_anomaly") | F.col("if_anomaly")) & F.col("farm_id").isNotNull())
        .groupBy("farm_id", F.window("date", window).alias("_w"))
        .agg(
            *figures("is_anomaly", "anomaly_score", "stat"),
            *figures("if_anomaly", "if_anomaly_score", "forest"),
            iforest.top_features(metrics, only_forest.columns).alias("_top"),
        )
    )

    def cluster(tag: str, method: str, features) -> Column:
        return F.when(
            F.col(f"rows_{tag}") >= min_cluster_size,
            F.struct(
                F.col(f"animals_{tag}").alias("affected_animals"),
                F.col(f"score_{tag}").alias("avg_anomaly_score"),
                F.col(f"types_{tag}").alias("animal_types"),
                F.lit(method).alias("detection_method"),
                features.alias("features"),
            ),
        )

    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    found = groups.select(
        "farm_id", F.col("_w.start").alias("start_date"), F.col("_w.end").alias("end_date"),
        F.inline(F.array_compact(F.array(cluster("stat", STAT, none), cluster("forest", FOREST, F.col("_top"))))),
    )
    return merge_clusters(found, min_cluster_size=min_cluster_size)


@runtime_checkable
class Detector(Protocol):
    """A custom detector; ``detect_clusters`` is optional."""

    def detect_anomalies(self, df: DataFrame, metrics: Sequence[str]) -> DataFrame: ...


def detect(
    df: DataFrame, settings: DetectionSettings | None = None, *, custom: Detector | None = None,
    ids: Sequence[str] = ("arrival_id",), order_by: Sequence[str] = ("date",), hot_key_rows: int | None = None,
) -> DataFrame:
    """Run the detector named by the settings, or a custom one."""
    settings = settings or DetectionSettings()
    present = [m for m in METRICS if m in df.columns]
    if not present:
        raise ValueError("no health metrics found in the table")
    if custom is not None:
        return custom.detect_anomalies(df, present)
    if settings.method == STAT:
        return detect_statistical(
            df, present, threshold=settings.threshold, window_size=settings.window_size, order_by=order_by,
            hot_key_rows=hot_key_rows,
        )
    if settings.method == FOREST:
        return iforest.detect(
            df, present, ids, trees=settings.n_estimators, sample_size=settings.max_samples,
            contamination=settings.contamination, seed=settings.random_state, max_rows=hot_key_rows,
        )
    if settings.method == "ensemble":
        return detect_ensemble(
            df, present, ids, settings=settings, order_by=order_by, hot_key_rows=hot_key_rows
        )
    raise ValueError(f"unknown detection method: {settings.method}")


def detect_outbreaks(
    df: DataFrame, settings: DetectionSettings | None = None, *, window: str = "7 days",
    min_cluster_size: int | None = None, custom: Detector | None = None,
) -> DataFrame:
    """Outbreak clusters of a table that ``detect`` returned, by the same method."""
    settings = settings or DetectionSettings()
    size = settings.min_anomalies_for_alert if min_cluster_size is None else min_cluster_size
    if custom is not None:
        if hasattr(custom, "detect_clusters"):
            return custom.detect_clusters(df, window, size)
        return detect_clusters_daily(df, min_cluster_size=size, method=settings.method)
    if settings.method == STAT:
        return detect_clusters(df, window=window, min_cluster_size=size)
    if settings.method == FOREST:
        return iforest.detect_forest_clusters(df, METRICS, window=window, min_cluster_size=size)
    return detect_ensemble_clusters(df, window=window, min_cluster_size=size)
