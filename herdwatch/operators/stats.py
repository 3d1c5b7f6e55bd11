"""Table statistics: description, drift, fingerprint, group counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMERIC_TYPES = ("int", "bigint", "double", "float", "smallint", "tinyint")


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None, limit: int = 10) -> DataFrame:
    """Mean, sample deviation, minimum, maximum and non-null count of the first numeric columns."""
    if columns is None:
        columns = [c for c, kind in df.dtypes if kind in NUMERIC_TYPES]
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std_dev"),
            F.min(F.col(c).cast("double")).alias("min"),
            F.max(F.col(c).cast("double")).alias("max"),
            F.count(c).alias("non_null"),
        )
        for c in list(columns)[:limit]
    ]
    return df.agg(F.array(*rows).alias("_rows")).selectExpr("inline(_rows)")


def data_drift(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Larger of mean shift and deviation shift per column, in reference deviations."""
    both = [c for c in columns if c in reference.columns and c in current.columns]
    moments = lambda df: df.agg(
        F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in both]).alias("x")
    )
    ref = moments(reference).scalar()
    now = moments(current)
    rows = []
    for c in both:
        unit = ref[c]["s"] + 1e-10
        shift = F.abs(F.col("x")[c]["m"] - ref[c]["m"]) / unit
        spread = F.abs(F.col("x")[c]["s"] - ref[c]["s"]) / unit
        rows.append(F.struct(F.lit(c).alias("column"), F.greatest(shift, spread).alias("drift")))
    return now.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-free fingerprint of the rows: count, sum and xor of the row digests.

    The digest is the leading 60 bits of the MD5 of the row as text.
    """
    columns = list(columns or df.columns)
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    digest = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    return df.select(digest.alias("_d")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.bit_xor("_d").alias("xor_digest"),
        F.sum(F.col("_d").cast("decimal(38,0)")).cast("string").alias("sum_digest"),
    )


def counts_by(df: DataFrame, column: str, into: str = "n") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(into))
