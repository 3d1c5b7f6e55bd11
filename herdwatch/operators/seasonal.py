"""Seasonal decomposition of daily series with windows.

A series holds one row per group and day, so a group is never longer than the calendar and
one shuffle by group is enough for everything below.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PERIOD = 7


def regular_days(df: DataFrame, value: str, keys: Sequence[str] = (), date: str = "day") -> DataFrame:
    """One row per calendar day between the first and last of each group.

    Gaps repeat the last known value, leading gaps take the first known one. A group with several
    rows for one day raises, as there is no single value to take; rows without a day are dropped. Adds the filled
    value ``_x``, the position ``_i`` from 0, the length ``_n`` and ``_given`` (false in gaps).
    """
    group = W.partitionBy(*keys)
    along = group.orderBy(date)
    day = F.to_date(date)
    filled = df.withColumns(
        {
            "_x": F.coalesce(
                F.last(value, ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, 0)),
                F.first(value, ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
            ).cast("double"),
            "_until": F.when(
                F.lead(day).over(along) <= day, F.raise_error(F.lit("a series has several rows for one day")).cast("date")
            ).otherwise(F.coalesce(F.date_sub(F.lead(day).over(along), 1), day)),
            "_start": F.min(day).over(group),
            "_end": F.max(day).over(group),
        }
    )
    daily = filled.withColumn("_day", F.explode(F.sequence(day, F.col("_until"))))
    return daily.withColumns(
        {
            "_given": F.col("_day") == day,
            "_i": F.datediff("_day", "_start"),
            "_n": F.datediff("_end", "_start") + 1,
        }
    ).drop("_until", "_start", "_end")


def _with_components(days: DataFrame, keys: Sequence[str], period: int, model: str) -> DataFrame:
    """Add trend, seasonal and residual to regular days (null for groups under two periods)."""
    if model not in ("additive", "multiplicative"):
        raise ValueError(f"unknown model: {model}")
    group = W.partitionBy(*keys)
    along = group.orderBy("_i")
    half = period // 2
    i, n, x = F.col("_i"), F.col("_n"), F.col("_x")
    around = F.sum(x).over(along.rowsBetween(-half, half))
    if period % 2 == 0:
        around = around - 0.5 * (F.lag(x, half).over(along) + F.lead(x, half).over(along))
    first, last = F.lit(half), n - 1 - half
    inside = (i >= first) & (i <= last) & (n >= 2 * period)
    trended = days.withColumn("_t", F.when(inside, around / period))

    # Both ends follow a line through the first / last `period` trend points; as in the usual
    # definition of this extrapolation, the last trend point itself is not part of the fit.
    def line(fits: Column) -> tuple[Column, Column]:
        y, at = F.when(fits, F.col("_t")), F.when(fits, i.cast("double"))
        return F.regr_slope(y, at).over(group), F.regr_intercept(y, at).over(group)

    head = (i >= first) & (i < F.least(first + period, last))
    tail = (i >= F.greatest(first, last - period)) & (i < last)
    (head_slope, head_base), (tail_slope, tail_base) = line(head), line(tail)
    lines = trended.withColumns({"_hs": head_slope, "_hb": head_base, "_ts": tail_slope, "_tb": tail_base})
    trend = F.when(i < first, i * F.col("_hs") + F.col("_hb")).when(
        i > last, i * F.col("_ts") + F.col("_tb")
    ).otherwise(F.col("_t"))
    ready = lines.withColumn("_trend", F.when(n >= 2 * period, trend))
    additive = model == "additive"
    ready = ready.withColumn("_d", x - F.col("_trend") if additive else x / F.col("_trend"))
    phase = W.partitionBy(*keys, F.pmod(i, F.lit(period)))
    ready = ready.withColumns({"_mean": F.avg("_d").over(phase), "_count": F.count("_d").over(phase)})
    # The mean of the period's means, each phase weighing the same.
    centre = F.sum(F.col("_mean") / F.nullif(F.col("_count"), F.lit(0))).over(group) / period
    ready = ready.withColumn("_centre", centre)
    seasonal = F.col("_mean") - F.col("_centre") if additive else F.col("_mean") / F.col("_centre")
    ready = ready.withColumn("_seasonal", seasonal)
    residual = (
        x - F.col("_trend") - F.col("_seasonal") if additive else x / F.col("_seasonal") / F.col("_trend")
    )
    return ready.withColumn("_residual", residual)


_WORK = ("_hs", "_hb", "_ts", "_tb", "_t", "_d", "_mean", "_count", "_centre", "_i", "_n")


def decompose(
    df: DataFrame, value: str, keys: Sequence[str] = (), date: str = "day", period: int = PERIOD,
    model: str = "additive",
) -> DataFrame:
    """Observed, trend, seasonal and residual per group and calendar day."""
    parts = _with_components(regular_days(df, value, keys, date), keys, period, model)
    return parts.select(
        *keys,
        F.col("_day").alias(date),
        F.col("_x").alias("observed"),
        F.col("_trend").alias("trend"),
        F.col("_seasonal").alias("seasonal"),
        F.col("_residual").alias("residual"),
    )


def adjust(
    df: DataFrame, value: str, keys: Sequence[str] = (), date: str = "day", period: int = PERIOD
) -> DataFrame:
    """Add ``{value}_seasonal_adj``; groups with fewer than two periods of rows keep their values."""
    sized = df.withColumn("_rows", F.count("*").over(W.partitionBy(*keys)))
    parts = _with_components(regular_days(sized, value, keys, date), keys, period, "additive")
    adjusted = F.when(F.col("_rows") < 2 * period, F.col(value)).otherwise(F.col("_x") - F.col("_seasonal"))
    return parts.filter("_given").withColumn(f"{value}_seasonal_adj", adjusted).select(
        *df.columns, f"{value}_seasonal_adj"
    )


def detect_seasonal(
    df: DataFrame, value: str, threshold: float = 3.0, keys: Sequence[str] = (), date: str = "day",
    period: int = PERIOD,
) -> DataFrame:
    """Flag rows whose residual is more than ``threshold`` deviations from the series' mean residual."""
    parts = _with_components(regular_days(df, value, keys, date), keys, period, "additive")
    group = W.partitionBy(*keys)
    spread = F.stddev_samp("_residual").over(group)
    z = F.when(spread > 1e-9, (F.col("_residual") - F.avg("_residual").over(group)) / spread)
    scored = parts.withColumn("residual_zscore", z).withColumn("residual", F.col("_residual"))
    flag = F.coalesce(F.abs("residual_zscore") > threshold, F.lit(False))
    return scored.filter("_given").withColumn(f"{value}_seasonal_anomaly", flag).select(
        *df.columns, "residual", "residual_zscore", f"{value}_seasonal_anomaly"
    )
