"""Column functions of the domain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DEFAULT_RANGE, HEALTH_PENALTY, NORMAL_RANGES

# Accepted date patterns of text columns.
DATE_PATTERNS = ("yyyy-M-d", "yyyy-M-d H:m:s", "d/M/yyyy", "M/d/yyyy")


def col_of(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def moment(as_of) -> Column:
    """A fixed "now", given as text, datetime or column."""
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")


def days_before(as_of, days: int) -> Column:
    return moment(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")


def whole_days_between(earlier: Column, later: Column) -> Column:
    """Complete days from ``earlier`` to ``later``, rounded down."""
    span = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.floor(span / F.lit(86_400_000_000))


def band(value: Column, bands: Sequence[tuple], index: int = 1) -> Column:
    """First entry whose lower bound is reached; the entry with bound None is the default."""
    out = None
    for entry in bands:
        if entry[0] is None:
            return out.otherwise(F.lit(entry[index]))
        hit = value >= entry[0]
        out = F.when(hit, F.lit(entry[index])) if out is None else out.when(hit, F.lit(entry[index]))
    return out


def ranked(value: Column, ranks: dict[str, int], unknown: int = 0) -> Column:
    out = None
    for name, rank in ranks.items():
        hit = value == name
        out = F.when(hit, F.lit(rank)) if out is None else out.when(hit, F.lit(rank))
    return out.otherwise(F.lit(unknown))


def normal_range(metric: str, animal_type: str | Column) -> tuple[Column, Column]:
    """Lower and upper bound of a metric for an animal type; unknown types get [0, 1]."""
    kind = col_of(animal_type)
    low, high = F.lit(DEFAULT_RANGE[0]), F.lit(DEFAULT_RANGE[1])
    for name, (lo, hi) in NORMAL_RANGES[metric].items():
        low = F.when(kind == name, F.lit(lo)).otherwise(low)
        high = F.when(kind == name, F.lit(hi)).otherwise(high)
    return low, high


def range_flag(metric: str, animal_type: str | Column = "animal_type") -> Column:
    """'extreme' outside the normal range, else null (also when value or type is missing)."""
    low, high = normal_range(metric, animal_type)
    outside = ~F.col(metric).between(low, high) & col_of(animal_type).isNotNull()
    return F.when(outside, F.lit("extreme"))


def clip_below(value: str | Column, floor: float) -> Column:
    """Raise values to ``floor``; null stays null."""
    value = col_of(value)
    return F.when(value.isNotNull(), F.greatest(value, F.lit(floor)))


def health_score(animal_type: str | Column = "animal_type", columns: Sequence[str] = tuple(HEALTH_PENALTY)) -> Column:
    """100 minus a penalty per metric for its distance from the normal range, within 0..100."""
    score = F.lit(100.0)
    for metric in ("temperature", "heart_rate"):
        if metric in columns:
            low, high = normal_range(metric, animal_type)
            away = F.greatest(low - F.col(metric), F.col(metric) - high)
            score = score - F.when(away > 0, away * HEALTH_PENALTY[metric]).otherwise(0.0)
    if "activity_level" in columns:
        away = F.abs(F.col("activity_level") - 1.0) * HEALTH_PENALTY["activity_level"]
        score = score - F.coalesce(away, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def animal_id(farm: str | Column, sequence: str | Column) -> Column:
    """farm_0001; longer numbers are kept whole."""
    digits = col_of(sequence).cast("string")
    padded = F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
    return F.concat(col_of(farm).cast("string"), F.lit("_"), padded)


def parse_date(text: str | Column) -> Column:
    """Text in one of the accepted patterns as a timestamp, else null; days and months may lack a leading zero."""
    text = col_of(text)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in DATE_PATTERNS])


def valid_date_range(start: str | Column, end: str | Column, as_of) -> Column:
    """True when both parse, start <= end, start is not before 2000 and end at most a year ahead."""
    first, last = F.try_to_timestamp(col_of(start)), F.try_to_timestamp(col_of(end))
    latest = (moment(as_of) + F.expr("INTERVAL 365 DAYS")).cast("timestamp")
    ok = (first <= last) & (first >= F.lit("2000-01-01").cast("timestamp")) & (last <= latest)
    return F.coalesce(ok, F.lit(False))


def size_text(size: str | Column) -> Column:
    """A byte count as text with unit, ties rounded to the even digit."""
    size = col_of(size).cast("double")
    out = F.format_string("%.1f B", F.bround(size, 1))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(size >= 1024.0**power, F.format_string(f"%.1f {unit}", F.bround(size / 1024.0**power, 1))).otherwise(out)
    return F.when(size == 0, "0 B").otherwise(out)
