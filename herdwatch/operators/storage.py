"""Stored tables that take updates: readings, kept by day, and animals, kept in buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import StoredTable, Version, parts_of
from .joins import keep_last, upsert

# The part of rows without a date.
NO_DAY = "none"
BUCKETS = 64


def day_of(date: str) -> Column:
    return F.coalesce(F.date_format(F.to_date(date), "yyyy-MM-dd"), F.lit(NO_DAY))


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string")


def create_metrics(df: DataFrame, path: str, date: str = "date") -> Version:
    """A new readings table with a part per day."""
    return StoredTable(df.sparkSession, path).create(df, day_of(date), {"date": date})


def read_metrics(spark: SparkSession, path: str, version: int | None = None, days: Sequence[str] | None = None) -> DataFrame:
    """One version of the table, by default the newest; with ``days`` (as text) only these days are read."""
    return StoredTable(spark, path).read(version, days)


def save_metrics(
    batch: DataFrame, path: str, keys: Sequence[str] = ("tag_id", "date"), arrival: str | None = None,
    date: str = "date", writer: tuple[str, int] | None = None,
) -> Version:
    """Upsert a batch of readings into the table at ``path`` as a new version; several writers may save at once.

    Only the days that occur in the batch (rows without a date are a day of their own) are read and
    rewritten. Readers see the table before or after the save, never between. Applying the same batch again
    changes no row; with ``writer`` (name, batch number) it makes no new version either.
    """
    if date not in keys:
        raise ValueError(f"{date} must be one of the keys, as rows stay in their day")
    return _save(batch, StoredTable(batch.sparkSession, path), day_of(date), keys, arrival, writer)


def create_animals(df: DataFrame, path: str, keys: Sequence[str] = ("tag_id",), buckets: int = BUCKETS) -> Version:
    """A new table of animals in ``buckets`` parts by hash of the keys."""
    return StoredTable(df.sparkSession, path).create(df, bucket_of(keys, buckets), {"keys": list(keys), "buckets": buckets})


def save_animals(batch: DataFrame, path: str, arrival: str | None = None, writer: tuple[str, int] | None = None) -> Version:
    """Upsert animals as a new version; only the buckets that occur in the batch are read and rewritten."""
    table = StoredTable(batch.sparkSession, path)
    made = table.version()
    if made is None:
        raise ValueError(f"no table at {path}")
    keys = made.info["keys"]
    return _save(batch, table, bucket_of(keys, made.info["buckets"]), keys, arrival, writer)


def read_animals(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return StoredTable(spark, path).read(version)


def _save(
    batch: DataFrame, table: StoredTable, part: Column, keys: Sequence[str], arrival: str | None, writer: tuple[str, int] | None,
) -> Version:
    if arrival is not None:
        batch = keep_last(batch, keys, arrival).drop(arrival)
    return table.change(parts_of(batch, part), lambda rows: upsert(rows, batch, [*keys]), part, writer)
