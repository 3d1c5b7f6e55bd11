"""Sources: files, tables, logs, alert log, snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import moment
from ..operators.clean import NUMERIC, fix_types
from .commits import StoredTable

# Stored tables.
SCHEMAS = {
    "livestock": "id int, tag_id string, animal_type string, age_months int, farm_id string, "
    "created_at timestamp, is_active boolean",
    "health_metrics": "id int, tag_id string, date timestamp, temperature double, heart_rate double, "
    "activity_level double, feed_intake double, water_intake double, is_anomaly boolean, anomaly_score double, "
    "created_at timestamp",
    "outbreak_alerts": "id int, farm_id string, alert_type string, severity string, description string, "
    "affected_animals int, start_date timestamp, end_date timestamp, is_resolved boolean, created_at timestamp",
}
ALERT_LOG_SCHEMA = (
    "id bigint, farm_id string, severity string, message string, description string, affected_animals bigint, "
    "is_resolved boolean, created_at timestamp, timestamp timestamp, line string, day date"
)


def _readable(df: DataFrame, numeric: Sequence[str], date: str) -> DataFrame:
    return fix_types(df, numeric=numeric, date=date)


def read_csv(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None, numeric: Sequence[str] = NUMERIC,
    date: str = "date",
) -> DataFrame:
    """CSV with header. Without a schema all columns are read as text (no extra pass over the
    data); the named numbers and the date are then converted, and what does not parse is null."""
    reader = spark.read.option("header", "true").option("mode", "PERMISSIVE")
    if schema is not None:
        reader = reader.schema(schema)
    return _readable(reader.csv(path), numeric, date)


def read_json(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None, numeric: Sequence[str] = (),
    date: str = "date", multi_line: bool = True,
) -> DataFrame:
    """An object or an array of objects per file, or JSON lines with ``multi_line=False``.

    A multi-line file cannot be split: large inputs should be JSON lines.
    """
    reader = spark.read.option("multiLine", str(multi_line).lower())
    if schema is not None:
        reader = reader.schema(schema)
    return _readable(reader.json(path), numeric, date)


def read_any(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Read by extension: .csv, .json or .parquet."""
    suffix = PurePosixPath(path.rstrip("/").replace("*", "x")).suffix.lower()
    if suffix == ".csv":
        return read_csv(spark, path, schema)
    if suffix == ".json":
        return read_json(spark, path, schema)
    if suffix == ".parquet":
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    raise ValueError(f"unsupported file format: {suffix or path}")


def run_sql(spark: SparkSession, text: str, tables: dict[str, DataFrame], **params) -> DataFrame:
    """A SQL statement over the given tables; ``:name`` parameters are bound, not pasted."""
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    return spark.sql(text, args=params or None)


def read_database(
    spark: SparkSession, url: str, table: str, *, partition_column: str | None = None, lower=None, upper=None,
    partitions: int = 1, **properties: str,
) -> DataFrame:
    """A table of a relational database; with bounds it is read by several tasks."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**properties)
    if partition_column is not None:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", str(lower))
            .option("upperBound", str(upper))
            .option("numPartitions", str(partitions))
        )
    return reader.load()


def check_readings(df: DataFrame, required: Sequence[str] = ()) -> None:
    """Raise when columns are missing or a reading has no animal or date."""
    missing = [c for c in (*required, "tag_id", "date") if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {sorted(set(missing))}")
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ("tag_id", "date")]).first()
    bad = [c for c in ("tag_id", "date") if nulls[c]]
    if bad:
        raise ValueError(f"null values found in {bad}")


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all current and rotated log files below a path, gzipped ones included."""
    return (
        spark.read.option("pathGlobFilter", "{*.log,*.log.*}")
        .text(path)
        .select(F.col("value").alias("line"), F.input_file_name().alias("file"))
    )


def read_alert_log(spark: SparkSession, path: str, schema: str = ALERT_LOG_SCHEMA) -> DataFrame:
    """The alert log; unreadable records are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def recent_alerts(
    spark: SparkSession, path: str, as_of, days: int = 7, schema: str = ALERT_LOG_SCHEMA
) -> DataFrame:
    """Alerts logged on the last days, newest day first; only those day folders are read."""
    today = F.to_date(moment(as_of))
    log = read_alert_log(spark, path, schema)
    recent = log.filter((F.col("day") > F.date_sub(today, days)) & (F.col("day") <= today))
    # A day may hold most of the log: its rows, even equal ones, are dealt to several tasks.
    return recent.orderBy(F.col("day").desc(), F.xxhash64(*log.columns), F.rand(0))


def todays_alert_lines(spark: SparkSession, path: str, as_of, schema: str = ALERT_LOG_SCHEMA) -> DataFrame:
    return recent_alerts(spark, path, as_of, 1, schema).select("line")


def latest_snapshot(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    """The newest snapshot of a kind, or None; no other snapshot is read."""
    table = StoredTable(spark, f"{path}/{kind}")
    newest = table.version()
    return None if newest is None else table.read(newest, [max(newest.parts)])


def load_report(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """The tables of a report stored by ``writers.save_report`` (small, so the shape is inferred)."""
    return {name: spark.read.json(f"{path}/{name}") for name in names}
