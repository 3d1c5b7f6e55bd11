"""Scaling of features. A fitted scaler is a small table: one row per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fit(df: DataFrame, columns: Sequence[str], method: str = "standard") -> DataFrame:
    """Centre and scale per column: mean and population deviation, or minimum and range.

    A spread of zero scales by 1. Columns without any value get no row.
    """
    present = [c for c in columns if c in df.columns]
    if method == "standard":
        pairs = {c: (F.avg(c), F.stddev_pop(c)) for c in present}
    elif method == "minmax":
        pairs = {c: (F.min(c).cast("double"), (F.max(c) - F.min(c)).cast("double")) for c in present}
    else:
        raise ValueError(f"unknown scaling method: {method}")
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.lit(method).alias("method"), centre.alias("center"),
            F.when(spread > 0, spread).otherwise(1.0).alias("scale"),
        )
        for c, (centre, spread) in pairs.items()
    ]
    return df.agg(F.array(*rows).alias("_rows")).selectExpr("inline(_rows)").filter("center IS NOT NULL")


def parameters(fitted: DataFrame):
    """The fitted table as one map value: column -> (center, scale)."""
    entries = F.collect_list(F.struct("column", F.struct("center", "scale")))
    return fitted.agg(F.map_from_entries(entries)).scalar()


def transform(df: DataFrame, fitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``{column}_normalized``; null stays null."""
    p = parameters(fitted)
    return df.withColumns(
        {f"{c}_normalized": (F.col(c) - p[c]["center"]) / p[c]["scale"] for c in columns if c in df.columns}
    )


def inverse_transform(df: DataFrame, fitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``{column}_original`` from ``{column}_normalized``."""
    p = parameters(fitted)
    return df.withColumns(
        {
            f"{c}_original": F.col(f"{c}_normalized") * p[c]["scale"] + p[c]["center"]
            for c in columns
            if f"{c}_normalized" in df.columns
        }
    )


def fit_transform(df: DataFrame, columns: Sequence[str], method: str = "standard") -> DataFrame:
    return transform(df, fit(df, columns, method), columns)


def save(fitted: DataFrame, path: str) -> None:
    fitted.coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
