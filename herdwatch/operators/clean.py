"""Cleaning of readings: fill, impute, deduplicate, coerce, flag, clip."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import ACTIVITY_FLOOR, METRICS, NORMAL_RANGES
from ..functions.scalars import clip_below, range_flag
from ..session import write_and_read
from .joins import keep_first
from .order_stats import quantiles
from .skew import with_nearest_values

NUMERIC = (*METRICS, "feed_intake", "water_intake")


def nan_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN in floating-point columns becomes null: a missing value, not one above all others."""
    kinds = dict(df.dtypes)
    found = [c for c in columns if kinds.get(c) in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in found}) if found else df


def fill_missing(
    df: DataFrame, metrics: Sequence[str] = METRICS, *, keys: Sequence[str] = ("tag_id",),
    order_by: Sequence[str] = ("arrival_id",), hot_key_rows: int | None = None,
) -> DataFrame:
    """Carry the last known value forward per animal, then the first known one backward.

    ``keys=()`` fills over the whole table.
    """
    present = [m for m in metrics if m in df.columns]
    prepared = with_nearest_values(nan_to_null(df, present), keys, order_by, present, hot_key_rows)
    so_far = prepared.window().rowsBetween(W.unboundedPreceding, 0)
    # Rows with nothing before them all take the first known value of the animal.
    whole = prepared.window().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    filled = prepared.df.withColumns(
        {
            m: F.coalesce(F.last(m, ignorenulls=True).over(so_far), F.first(m, ignorenulls=True).over(whole))
            for m in present
        }
    )
    return prepared.finish(filled)


def impute_mean(df: DataFrame, columns: Sequence[str] = NUMERIC, keep: bool = False) -> DataFrame:
    """Replace remaining nulls by the mean of the column.

    With ``keep`` the table is stored and its means are observed while it is written, so that ``df`` is computed once.
    """
    present = [c for c in columns if c in df.columns]
    df = nan_to_null(df, present)
    if keep and present:
        seen = Observation()
        # On top of the write: a task that is repeated counts once.
        df = write_and_read(df.observe(seen, *[F.avg(c).alias(c) for c in present]), "filled")
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(mean).cast("double")) for c, mean in seen.get.items()})
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in present])).scalar()
    return df.withColumns({c: F.coalesce(F.col(c), means[c]) for c in present})


def remove_duplicates(
    df: DataFrame, keys: Sequence[str] = ("tag_id", "date"), arrival: str = "arrival_id"
) -> DataFrame:
    """Keep the first arrival per key."""
    present = [k for k in keys if k in df.columns]
    return keep_first(df, present, arrival) if present else df


def fix_types(df: DataFrame, numeric: Sequence[str] = NUMERIC, date: str = "date") -> DataFrame:
    """Numbers as double and the date as timestamp; what does not parse, and NaN, becomes null."""
    kinds = dict(df.dtypes)
    fixed = {c: F.col(c).try_cast("double") for c in numeric if c in kinds and kinds[c] != "double"}
    if kinds.get(date) == "string":
        fixed[date] = F.try_to_timestamp(F.col(date))
    return nan_to_null(df.withColumns(fixed) if fixed else df, numeric)


def flag_ranges(df: DataFrame, metrics: Sequence[str] = tuple(NORMAL_RANGES)) -> DataFrame:
    """Add ``{metric}_flag``: 'extreme' outside the normal range of the animal type."""
    if "animal_type" not in df.columns:
        return df
    return df.withColumns({f"{m}_flag": range_flag(m) for m in metrics if m in df.columns})


def clip_activity(df: DataFrame, floor: float = ACTIVITY_FLOOR) -> DataFrame:
    if "activity_level" not in df.columns:
        return df
    return df.withColumn("activity_level", clip_below("activity_level", floor))


def clean(
    df: DataFrame, *, order_by: Sequence[str] = ("arrival_id",), sort: bool = False,
    hot_key_rows: int | None = None, keep: bool = False,
) -> DataFrame:
    """All cleaning steps. ``sort`` orders the result by date, which costs one more shuffle.

    ``keep`` stores the filled table instead of filling a second time for the means.
    """
    out = (
        df.transform(fill_missing, order_by=order_by, hot_key_rows=hot_key_rows)
        .transform(impute_mean, keep=keep)
        .transform(remove_duplicates, arrival=order_by[0])
        .transform(fix_types)
        .transform(flag_ranges)
        .transform(clip_activity)
    )
    return out.orderBy("date") if sort and "date" in out.columns else out


def iqr_outliers(df: DataFrame, column: str, *, factor: float = 1.5, max_rows: int | None = None) -> DataFrame:
    """Rows outside the quartiles by more than ``factor`` times their distance; NaN is no value."""
    if column not in df.columns:
        return df
    df = nan_to_null(df, [column])
    quartiles = quantiles(df, column, {"q1": 0.25, "q3": 0.75}, max_rows=max_rows)
    q = quartiles.select(F.struct("q1", "q3")).scalar()
    reach = (q["q3"] - q["q1"]) * factor
    return df.filter((F.col(column) < q["q1"] - reach) | (F.col(column) > q["q3"] + reach))
