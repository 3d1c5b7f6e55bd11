"""Structured logs: parsing, filters, error and performance reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import LOG_LEVELS
from ..functions.scalars import moment, ranked
from .filters import newest_first
from .order_stats import nearest_rank

# Fixed value: where a JSON record starts inside a line with other output.
RECORD_PATTERN = r'(\{"timestamp".*\})'
FIELDS = {
    "timestamp": "string", "level": "string", "logger": "string", "module": "string", "function": "string",
    "message": "string", "operation": "string", "duration_ms": "double",
}


def parse_lines(lines: DataFrame, column: str = "line", fields: dict[str, str] = FIELDS) -> DataFrame:
    """Log records of text lines: the whole line as JSON, else the record inside it, else dropped."""
    # All fields are read as text first: a value of the wrong type must not spoil its record.
    shape = ", ".join([*[f"{name} string" for name in fields], "_bad string"])
    options = {"columnNameOfCorruptRecord": "_bad"}

    def parse(text):
        record = F.from_json(text, shape, options)
        empty = F.rlike(text, F.lit(r"^\{\s*\}$"))
        return F.when(F.startswith(text, F.lit("{")) & record["_bad"].isNull() & ~empty, record)

    text = F.trim(F.col(column))
    inside = F.regexp_extract(F.col(column), RECORD_PATTERN, 1)
    # A one-element list instead of a filter: a filter would be pushed below and parse twice.
    found = lines.withColumn("_r", F.explode(F.array(F.coalesce(parse(text), parse(inside))))).filter(
        F.col("_r").isNotNull()
    )
    taken = {
        name: F.try_to_timestamp(F.col("_r")[name]) if name == "timestamp"
        else F.col("_r")[name] if kind == "string"
        else F.col("_r")[name].try_cast(kind)
        for name, kind in fields.items()
    }
    keep = [c for c in lines.columns if c != column and c not in fields]
    return found.select(*keep, *[value.alias(name) for name, value in taken.items()])


def level_rank(level: str = "level"):
    """Priority of a level: a missing level counts as DEBUG, an unknown one as 0."""
    return ranked(F.coalesce(F.col(level), F.lit("DEBUG")), LOG_LEVELS)


def read_logs(logs: DataFrame, since=None, until=None, level: str | None = None) -> DataFrame:
    """Records between two times (inclusive) of at least the given level."""
    out = logs
    if since is not None:
        out = out.filter(F.col("timestamp") >= moment(since))
    if until is not None:
        out = out.filter(F.col("timestamp") <= moment(until))
    if level is not None:
        out = out.filter(level_rank() >= LOG_LEVELS.get(level, 0))
    return out


def last_hours(logs: DataFrame, as_of, hours: int | None) -> DataFrame:
    if hours is None:
        return logs
    return logs.filter(F.col("timestamp") >= moment(as_of) - F.expr(f"INTERVAL {int(hours)} HOURS"))


def search_logs(
    logs: DataFrame, text: str, as_of=None, hours: int | None = None, case_sensitive: bool = False
) -> DataFrame:
    """Records that contain the text anywhere in their JSON form."""
    record = F.to_json(F.struct(*logs.columns))
    if not case_sensitive:
        record, text = F.lower(record), text.lower()
    return last_hours(logs, as_of, hours).filter(F.contains(record, F.lit(text)))


def recent_logs(logs: DataFrame, count: int = 10, level: str | None = None, tie: str = "event_id") -> DataFrame:
    return newest_first(read_logs(logs, level=level), "timestamp", tie, count)


def log_summary(logs: DataFrame, as_of=None, hours: int | None = None, last: int = 5, tie: str = "event_id") -> DataFrame:
    """Section, key and value: total, count per level, loggers, first and last time, last messages."""
    rows = last_hours(logs, as_of, hours)
    # One pass over the log leaves a row per level and logger; the rest is counted from those.
    counted = (
        rows.groupBy(
            F.coalesce("level", F.lit("UNKNOWN")).alias("level"), F.coalesce("logger", F.lit("UNKNOWN")).alias("logger")
        )
        .agg(F.count("*").alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    )
    sets = [[F.col("level")], [F.col("logger")], []]
    sums = counted.groupingSets(sets, "level", "logger").agg(
        F.grouping_id().alias("_g"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
    )

    def line(section: str, key, value):
        return F.struct(F.lit(section).alias("section"), key.alias("key"), value.cast("string").alias("value"))

    stamp = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    by_level = F.array(line("level_distribution", F.col("level"), F.col("n")))
    by_logger = F.array(line("unique_loggers", F.col("logger"), F.lit(1)))
    total = F.array(
        line("total", F.lit("total_logs"), F.col("n")),
        line("time_range", F.lit("first"), F.date_format("lo", stamp)),
        line("time_range", F.lit("last"), F.date_format("hi", stamp)),
    )
    report = sums.select(
        F.inline(F.when(F.col("_g") == 1, by_level).when(F.col("_g") == 2, by_logger).otherwise(total))
    )
    newest = newest_first(rows.select("timestamp", tie, "message"), "timestamp", tie, last).select(
        F.lit("recent_messages").alias("section"), F.col(tie).cast("string").alias("key"), F.col("message").alias("value")
    )
    return report.unionByName(newest)


def errors_by(logs: DataFrame, group_by: str = "message", as_of=None, hours: int | None = None) -> DataFrame:
    """Number of records of level ERROR or above per message, module or function."""
    column = group_by if group_by in ("message", "module", "function") else "message"
    rows = read_logs(last_hours(logs, as_of, hours), level="ERROR")
    key = F.coalesce(F.col(column), F.lit("Unknown")) if column in logs.columns else F.lit("Unknown")
    return rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("errors"))


def top_errors(logs: DataFrame, as_of=None, hours: int | None = None, limit: int = 10) -> DataFrame:
    """The most common error messages; ties by message."""
    return errors_by(logs, "message", as_of, hours).orderBy(F.col("errors").desc(), "key").limit(limit)


def performance(
    logs: DataFrame, as_of=None, hours: int | None = None, keys: Sequence[str] = ("operation",),
    max_rows: int | None = None,
) -> DataFrame:
    """Count, mean, extremes and 95th percentile (value at rank floor(0.95 n)) per operation."""
    timed = last_hours(logs, as_of, hours).filter(
        F.col("operation").isNotNull() & F.col("duration_ms").isNotNull()
    )
    figures = timed.groupBy(*keys).agg(
        F.count("*").alias("count"),
        F.avg("duration_ms").alias("avg_ms"),
        F.min("duration_ms").alias("min_ms"),
        F.max("duration_ms").alias("max_ms"),
    )
    # Both sides hold one row per operation.
    return figures.join(nearest_rank(timed, "duration_ms", 0.95, keys, "p95_ms", max_rows), [*keys])


def slowest(logs: DataFrame, as_of=None, hours: int | None = None, limit: int = 5) -> DataFrame:
    """The operations with the highest mean duration."""
    return performance(logs, as_of, hours).orderBy(F.col("avg_ms").desc(), "operation").limit(limit)
