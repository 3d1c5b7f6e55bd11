"""Joins between readings and animals, and the generic upsert."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def with_animals(
    readings: DataFrame, livestock: DataFrame, columns: Sequence[str] = ("animal_type", "farm_id")
) -> DataFrame:
    """Readings with the columns of their animal; readings of unknown animals are kept.

    No broadcast is forced: the herd table grows with the data, so Spark decides by its size,
    and splits hot animals of a sort-merge join at run time.
    """
    wanted = [c for c in columns if c not in readings.columns]
    return readings.join(livestock.select("tag_id", *wanted), "tag_id", "left")


def animals_with_readings(livestock: DataFrame, readings: DataFrame) -> DataFrame:
    return livestock.join(readings.select("tag_id"), "tag_id", "left_semi")


def animals_without_readings(livestock: DataFrame, readings: DataFrame) -> DataFrame:
    return livestock.join(readings.select("tag_id"), "tag_id", "left_anti")


def readings_without_animal(readings: DataFrame, livestock: DataFrame) -> DataFrame:
    return readings.join(livestock.select("tag_id"), "tag_id", "left_anti")


def keep_last(df: DataFrame, keys: Sequence[str], arrival: str) -> DataFrame:
    """The latest arrival per key; each map task passes on one row per key."""
    newest = W.partitionBy(*keys).orderBy(F.col(arrival).desc())
    return df.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") == 1).drop("_rank")


def keep_first(df: DataFrame, keys: Sequence[str], arrival: str) -> DataFrame:
    """The first arrival per key; each map task passes on one row per key."""
    oldest = W.partitionBy(*keys).orderBy(F.col(arrival))
    return df.withColumn("_rank", F.row_number().over(oldest)).filter(F.col("_rank") == 1).drop("_rank")


def upsert(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], arrival: str | None = None
) -> DataFrame:
    """Existing rows overwritten by, and extended with, the incoming ones.

    Incoming columns replace the stored ones even when null; stored columns that the batch
    does not carry are kept. Keys match null-safely: a null key is the same as another null. ``existing`` holds each key once; within the batch the latest
    ``arrival`` wins (without ``arrival`` the batch must hold each key once).
    """
    if arrival is not None:
        incoming = keep_last(incoming, keys, arrival)
        if arrival not in existing.columns:
            incoming = incoming.drop(arrival)
    given = [c for c in incoming.columns if c not in keys and c in existing.columns]
    replaced = [*keys, *given]
    new = incoming.select(*[F.col(c).alias(f"_new_{c}") for c in replaced], F.lit(True).alias("_new"))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys))
    joined = existing.join(new, same, "full")
    return joined.select(
        *[
            F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in replaced else F.col(c)
            for c in existing.columns
        ]
    )
