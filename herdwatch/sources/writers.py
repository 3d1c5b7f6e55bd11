"""Sinks: exports, alert log, snapshots, reports."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ESSENTIAL_ANOMALY_COLUMNS
from ..functions.scalars import moment
from ..operators.alerts import with_defaults
from ..operators.stats import describe_numeric
from . import readers
from .commits import StoredTable

log = logging.getLogger(__name__)
# Text formats keep microseconds.
STAMPS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def essential_columns(df: DataFrame, wanted: Sequence[str] = ESSENTIAL_ANOMALY_COLUMNS) -> list[str]:
    """The wanted columns that exist."""
    return [c for c in wanted if c in df.columns]


def _nested_to_text(df: DataFrame) -> DataFrame:
    """CSV holds no lists or structs: write them as JSON text."""
    nested = {c: F.to_json(c) for c, kind in df.dtypes if kind.startswith(("array", "struct", "map"))}
    return df.withColumns(nested) if nested else df


def write_csv(df: DataFrame, path: str) -> str:
    _nested_to_text(df).write.mode("overwrite").options(**STAMPS).csv(path, header=True)
    return path


def write_json(df: DataFrame, path: str, as_of) -> str:
    """Records as JSON lines under ``data``; one row about the export under ``metadata``."""
    df.write.mode("overwrite").options(**STAMPS).option("ignoreNullFields", "false").json(f"{path}/data")
    export_metadata(df, as_of).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    return path


def export_metadata(df: DataFrame, as_of) -> DataFrame:
    """Export date, record count, columns and types: one row."""
    names = F.array(*[F.lit(c) for c in df.columns])
    kinds = F.array(*[F.lit(k) for _, k in df.dtypes])
    return df.agg(F.count(F.lit(1)).alias("record_count")).select(
        F.date_format(moment(as_of), "yyyy-MM-dd'T'HH:mm:ss").alias("export_date"),
        "record_count",
        names.alias("columns"),
        F.map_from_arrays(names, kinds).alias("data_types"),
    )


def export(
    df: DataFrame, folder: str, name: str, as_of, formats: Sequence[str] = ("csv", "json"), summary: bool = False
) -> dict[str, str]:
    """Write a table in several formats; returns format -> path.

    Nothing is written for an empty table, and one failing format does not stop the others.
    """
    if df.isEmpty():
        log.warning("empty table %s not exported", name)
        return {}
    done: dict[str, str] = {}
    for fmt in formats:
        path = f"{folder}/{name}_{fmt}"
        try:
            if fmt == "csv":
                write_csv(df, path)
            elif fmt == "json":
                write_json(df, path, as_of)
            elif fmt == "parquet":
                df.write.mode("overwrite").parquet(path)
            else:
                raise ValueError(f"unknown export format: {fmt}")
            done[fmt] = path
        except Exception as error:  # the other formats still get written
            log.warning("export of %s as %s failed: %s", name, fmt, error)
    if summary:
        describe_numeric(df).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}_summary")
        done["summary"] = f"{folder}/{name}_summary"
    return done


def export_anomalies(df: DataFrame, folder: str, as_of, details: bool = True) -> dict[str, str]:
    rows = df if details else df.select(*essential_columns(df))
    return export(rows, folder, "anomaly_report", as_of, ("csv",), summary=True)


def export_alerts(df: DataFrame, folder: str, as_of) -> dict[str, str]:
    return export(df, folder, "outbreak_alerts", as_of, ("csv", "json"), summary=True)


def export_recent_alerts(spark: SparkSession, path: str, folder: str, as_of, days: int = 7) -> dict[str, str]:
    """The alerts that were logged on the last days, exported; only those day folders of the log are read."""
    return export_alerts(readers.recent_alerts(spark, path, as_of, days), folder, as_of)


def export_health_metrics(df: DataFrame, folder: str, as_of, time_range: str | None = None) -> dict[str, str]:
    name = f"health_metrics_{time_range}" if time_range else "health_metrics"
    return export(df, folder, name, as_of, ("csv",), summary=True)


def append_alerts(df: DataFrame, path: str) -> None:
    """Store alerts."""
    df.write.mode("append").parquet(path)


def log_alerts(df: DataFrame, path: str, as_of) -> None:
    """Append alerts to the alert log, one folder per day."""
    with_defaults(df, as_of).write.mode("append").options(**STAMPS).partitionBy("day").json(path)


def export_logs(logs: Sequence[DataFrame], path: str, fmt: str = "json") -> str:
    """Records of one or more logs, with the union of their fields."""
    rows = logs[0]
    for other in logs[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    if fmt == "csv":
        return write_csv(rows, path)
    if fmt != "json":
        raise ValueError(f"unknown log format: {fmt}")
    rows.write.mode("overwrite").options(**STAMPS).json(path)
    return path


def save_report(tables: dict[str, DataFrame], path: str) -> None:
    """A report of several small tables, one JSON folder each."""
    for name, table in tables.items():
        table.coalesce(1).write.mode("overwrite").options(**STAMPS).json(f"{path}/{name}")


def save_snapshot(df: DataFrame, path: str, kind: str, taken_at: str) -> str:
    """A full copy under kind and time; ``readers.latest_snapshot`` finds the newest.

    A snapshot is a part of a stored table per kind, so it can be read once it is complete and not before; a second one
    of the same time raises.
    """
    table = StoredTable(df.sparkSession, f"{path}/{kind}")
    if table.version() is None:
        try:
            table.create(df, F.lit(taken_at))
            return f"{path}/{kind}"
        except FileExistsError:
            # Another writer was first; its table takes this snapshot.
            pass

    def first(rows: DataFrame) -> DataFrame:
        if taken_at in table.version().parts:
            raise FileExistsError(f"there is a snapshot of {kind} at {taken_at}")
        return df

    table.change([taken_at], first, F.lit(taken_at), schema=df.schema)
    return f"{path}/{kind}"


def write_lines(report: DataFrame, path: str, order: Sequence[str] = ("section", "item", "line_no")) -> None:
    """Write a line report as text, in order."""
    report.orderBy(*order).select("line").write.mode("overwrite").text(path)
