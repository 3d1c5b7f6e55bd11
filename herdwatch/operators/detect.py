"""Rolling z-score detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..constants import METRICS
from .skew import with_previous_rows

# A spread below this is float noise on a constant window.
ZERO_SPREAD = 1e-9
# A score this close to the threshold equals it. Simple windows hit simple thresholds exactly:
# one value among three equal ones has z = 1.5, which is not above 1.5.
SAME_SCORE = 1e-9


def zscore(value: Column, frame: WindowSpec) -> Column:
    """(value - mean) / sample deviation over the frame; null when the spread is zero."""
    spread = F.stddev_samp(value).over(frame)
    return F.when(spread > ZERO_SPREAD, (value - F.avg(value).over(frame)) / spread)


def rolling_zscore(
    df: DataFrame,
    metrics: Sequence[str] = METRICS,
    *,
    partition_by: Sequence[str] = ("tag_id",),
    order_by: Sequence[str] = ("date",),
    window_size: int = 7,
    hot_key_rows: int | None = None,
) -> DataFrame:
    """Add ``{metric}_zscore`` over the last ``window_size`` rows of each animal.

    ``partition_by=()`` treats the whole table as one series, in row order.
    """
    prepared = with_previous_rows(df, partition_by, order_by, window_size - 1, hot_key_rows)
    frame = prepared.window().rowsBetween(-(window_size - 1), 0)
    scored = prepared.df.withColumns(
        {f"{m}_zscore": zscore(F.col(m), frame) for m in metrics if m in df.columns}
    )
    return prepared.finish(scored)


def flag_scores(df: DataFrame, metrics: Sequence[str], threshold: float) -> DataFrame:
    """Add the flag per metric (strictly above the threshold), ``is_anomaly`` and ``anomaly_score``."""
    present = [m for m in metrics if f"{m}_zscore" in df.columns]
    if not present:
        return df
    sizes = [F.abs(F.col(f"{m}_zscore")) for m in present]
    flags = [F.coalesce(size > threshold + SAME_SCORE, F.lit(False)) for size in sizes]
    any_flag = flags[0]
    for flag in flags[1:]:
        any_flag = any_flag | flag
    score = F.greatest(*sizes) if len(sizes) > 1 else sizes[0]
    return df.withColumns(
        {
            **{f"{m}_anomaly": flag for m, flag in zip(present, flags)},
            "is_anomaly": any_flag,
            "anomaly_score": score,
        }
    )


def detect_statistical(
    df: DataFrame,
    metrics: Sequence[str] = METRICS,
    *,
    threshold: float = 3.0,
    window_size: int = 7,
    partition_by: Sequence[str] = ("tag_id",),
    order_by: Sequence[str] = ("date",),
    hot_key_rows: int | None = None,
) -> DataFrame:
    """Z-scores, one flag per metric, the combined flag and the largest absolute z.

    With the current row inside the window, |z| cannot exceed (w - 1) / sqrt(w): a threshold
    of 3.0 needs a window of at least 11 rows.
    """
    scored = rolling_zscore(
        df, metrics, partition_by=partition_by, order_by=order_by, window_size=window_size,
        hot_key_rows=hot_key_rows,
    )
    return flag_scores(scored, metrics, threshold)
