"""Stored daily rollups that follow a stored table: counts and sums from changes, distinct counts from bitmaps.

A rollup keeps one row per day and combination of keys. When its source gets new versions, the changed days' rows as
they were (sign -1) and as they are (sign +1) are summed up to a correction per day and keys, which is merged into
the stored rows; days that did not change are not read. Least and greatest values, and bitmaps of animals, cannot be
taken back: these are made anew for the changed days, from the same rows with sign +1.

Animals have dense numbers, kept in a table of their own, so that a set of animals is a row of bits per 32,768
numbers. Bitmaps of days are merged by "or", and counting distinct animals over any days and types needs no
shuffle of readings and no copies of rows per distinct column.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import StoredTable, Version, parts_of
from .order_stats import number_rows
from .reports import daily_advice
from .storage import BUCKETS, bucket_of

DAY, SOURCE = "day", "source"
# Sums are decimals: what is added and taken back again leaves nothing behind.
EXACT = "decimal(38,12)"
COUNT = "rows"


class Rollup:
    """A rollup at ``path`` over the stored table ``source``, whose parts are days.

    ``keys`` and ``sums`` give its columns by name; ``extremes`` holds names of (least | greatest, column). Null is
    a key. Integers are summed as they are, other numbers as decimals of twelve places; missing values and
    those beyond 26 digits are left out of a sum.
    """

    def __init__(
        self, spark: SparkSession, source: str, path: str, keys: dict[str, Column], sums: dict[str, Column] | None = None,
        extremes: dict[str, tuple[str, Column]] | None = None,
    ):
        self.source, self.table = StoredTable(spark, source), StoredTable(spark, path)
        self.keys, self.sums, self.extremes = keys, sums or {}, extremes or {}

    def read(self, days: Iterable[str] | None = None) -> DataFrame:
        return self.table.read(parts=days)

    def refresh(self) -> Version:
        """Brings the rollup up to the source's newest version; nothing happens if it is there already."""
        newest = self.source.version()
        if newest is None:
            raise ValueError(f"no table at {self.source.path}")
        held = self.table.version()
        if held is None:
            return self.table.create(self._fresh(-1, newest.number), F.col(DAY), {SOURCE: newest.number})
        since = held.batches.get(SOURCE, held.info.get(SOURCE, -1))
        if since >= newest.number:
            return held
        old = self.source.version(since)
        days = {k for v in (old, newest) for k in v.parts if old.parts.get(k) != newest.parts.get(k)}
        correction = self._fresh(since, newest.number)

        def merged(rows: DataFrame) -> DataFrame:
            # The stored extremes of these days give way to the new ones.
            before = rows.withColumns({n: F.lit(None).cast(dict(rows.dtypes)[n]) for n in self.extremes})
            total = before.unionByName(correction).groupBy(DAY, *self.keys).agg(
                F.sum(COUNT).alias(COUNT), *[F.sum(n).cast(t).alias(n) for n, t in rows.dtypes if n in self.sums],
                *[self._extreme(n, F.col(n)) for n in self.extremes],
            )
            return total.where(F.col(COUNT) > 0).select(*rows.columns)

        return self.table.change(days, merged, F.col(DAY), (SOURCE, newest.number))

    def _extreme(self, name: str, column: Column) -> Column:
        return (F.min if self.extremes[name][0] == "least" else F.max)(column).alias(name)

    def _fresh(self, since: int, until: int) -> DataFrame:
        """Corrections between two versions of the source: a row per day and keys."""
        rows = self.source.changes(since, until)
        day = F.coalesce(F.date_format(F.to_date(self._date()), "yyyy-MM-dd"), F.lit("none"))
        picked = rows.select(
            day.alias(DAY), "sign", *[c.alias(n) for n, c in self.keys.items()], *[c.alias(f"_s_{n}") for n, c in self.sums.items()],
            *[F.when(F.col("sign") > 0, c).alias(f"_e_{n}") for n, (_, c) in self.extremes.items()],
        )
        whole = {n for n in self.sums if dict(picked.dtypes)[f"_s_{n}"] in ("tinyint", "smallint", "int", "bigint")}

        def summed(name: str) -> Column:
            value = F.col(f"_s_{name}")
            if name in whole:
                return F.coalesce(F.sum(value.cast("long") * F.col("sign")), F.lit(0).cast("long")).alias(name)
            exact = value.try_cast(EXACT)
            return F.coalesce(F.sum(F.when(F.col("sign") > 0, exact).otherwise(-exact)), F.lit(0)).cast(EXACT).alias(name)

        return picked.groupBy(DAY, *self.keys).agg(
            F.sum("sign").alias(COUNT), *[summed(n) for n in self.sums], *[self._extreme(n, F.col(f"_e_{n}")) for n in self.extremes]
        )

    def _date(self) -> str:
        return self.source.version().info.get("date", "date")


# Dense numbers of animals
def number_animals(animals: DataFrame, path: str, key: str = "tag_id") -> Version:
    """Gives every animal a number from 1 on, without gaps; known animals keep theirs, null is no animal."""
    table = StoredTable(animals.sparkSession, path)
    held = table.version()
    known = animals.where(F.col(key).isNotNull()).select(key).distinct()
    if held is None:
        numbered = number_rows(known, [key], "_n").select(key, (F.col("_n") + 1).cast("long").alias("number"))
        return table.create(numbered, bucket_of([key], BUCKETS), {"key": key})
    stored = table.read(held)
    new = known.join(stored.select(key), key, "left_anti")
    top = stored.agg(F.max("number")).first()[0] or 0
    numbered = number_rows(new, [key], "_n").select(key, (F.col("_n") + 1 + top).cast("long").alias("number"))
    part = bucket_of([key], BUCKETS)
    concerned = parts_of(new, part)
    if not concerned:
        return held

    def added(rows: DataFrame) -> DataFrame:
        if table.version().number != held.number:
            raise RuntimeError("another writer numbers animals; run again")
        return rows.unionByName(numbered)

    return table.change(concerned, added, part)


def bits(number: Column) -> tuple[Column, Column]:
    """(bucket, position) of a number in bitmaps of 32,768 bits."""
    return F.bitmap_bucket_number(number), F.bitmap_bit_position(number)


class AnimalSets:
    """Bitmaps of the animals that have readings, per day and keys, over the stored readings at ``source``."""

    def __init__(self, spark: SparkSession, source: str, numbers: str, path: str, keys: dict[str, Column], key: str = "tag_id"):
        self.source, self.numbers, self.table = StoredTable(spark, source), StoredTable(spark, numbers), StoredTable(spark, path)
        self.keys, self.key = keys, key

    def read(self, days: Iterable[str] | None = None) -> DataFrame:
        return self.table.read(parts=days)

    def refresh(self) -> Version:
        """Makes the bitmaps of days that changed anew; numbers animals that are new."""
        newest, held = self.source.version(), self.table.version()
        if newest is None:
            raise ValueError(f"no table at {self.source.path}")
        since = -1 if held is None else held.batches.get(SOURCE, held.info.get(SOURCE, -1))
        if held is not None and since >= newest.number:
            return held
        rows = self.source.changes(since, newest.number).where("sign > 0").drop("sign")
        number_animals(rows, self.numbers.path, self.key)
        made = self._bitmaps(rows, newest)
        if held is None:
            return self.table.create(made, F.col(DAY), {SOURCE: newest.number})
        old = self.source.version(since)
        days = {k for v in (old, newest) for k in v.parts if old.parts.get(k) != newest.parts.get(k)}
        return self.table.change(days, lambda _: made, F.col(DAY), (SOURCE, newest.number))

    def _bitmaps(self, rows: DataFrame, version: Version) -> DataFrame:
        day = F.coalesce(F.date_format(F.to_date(version.info.get("date", "date")), "yyyy-MM-dd"), F.lit("none"))
        # A row per animal, day and keys before the join, whatever the number of readings.
        each = rows.where(F.col(self.key).isNotNull()).select(day.alias(DAY), *[c.alias(n) for n, c in self.keys.items()], self.key).distinct()
        bucket, position = bits(F.col("number"))
        return (
            each.join(self.numbers.read(), self.key)
            .groupBy(DAY, *self.keys, bucket.alias("bucket")).agg(F.bitmap_construct_agg(position).alias("animals"))
        )


def distinct_animals(sets: DataFrame, *keys: str) -> DataFrame:
    """Distinct animals per ``keys`` (or of all rows): bitmaps merged per bucket, then their bits summed."""
    merged = sets.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("animals").alias("animals"))
    return merged.groupBy(*keys).agg(F.coalesce(F.sum(F.bitmap_count("animals")), F.lit(0)).alias("total_animals"))


def days_since(version: Version, as_of, days: int | None) -> list[str]:
    """The parts of the last days; whole days only."""
    keys = list(version.parts)
    if days is None:
        return keys
    first = (datetime.fromisoformat(str(as_of)) - timedelta(days=days)).strftime("%Y-%m-%d")
    return sorted(k for k in keys if k != "none" and k >= first)


# The reports over rollups
def readings_rollup(spark: SparkSession, source: str, path: str) -> Rollup:
    """Readings per day, farm and type: rows, anomalies, scores."""
    keys = {n: F.col(n) for n in ("farm_id", "animal_type")}
    score = F.when(~F.isnan("anomaly_score"), F.col("anomaly_score"))
    sums = {"anomalies": F.col("is_anomaly").cast("int"), "score": score, "scored": score.isNotNull().cast("int")}
    return Rollup(spark, source, path, keys, sums)


def alerts_rollup(spark: SparkSession, source: str, path: str) -> Rollup:
    """Alerts per day, severity and farm."""
    return Rollup(spark, source, path, {
        "severity": F.coalesce("severity", F.lit("unknown")), "farm": F.coalesce(F.col("farm_id").cast("string"), F.lit("unknown")),
    })


def logs_rollup(spark: SparkSession, source: str, path: str) -> Rollup:
    """Log records per day, level, logger and message, with the first and last time."""
    keys = {"level": F.coalesce("level", F.lit("UNKNOWN")), "logger": F.coalesce("logger", F.lit("UNKNOWN")), "message": F.col("message")}
    return Rollup(spark, source, path, keys, extremes={"first": ("least", F.col("timestamp")), "last": ("greatest", F.col("timestamp"))})


def timeline(rows: DataFrame) -> DataFrame:
    """Rows, anomalies and mean score per day (D3)."""
    mean = F.when(F.sum("scored") > 0, (F.sum("score") / F.sum("scored")).cast("double"))
    return rows.where("day <> 'none'").groupBy(F.to_date("day").alias("day")).agg(
        F.sum(COUNT).alias("total_records"), F.sum("anomalies").alias("anomalies"), mean.alias("avg_score")
    )


def alert_stats(rows: DataFrame) -> DataFrame:
    """Total and counts by severity, farm and day (D5): (section, key, alerts)."""
    sections = [("total_alerts", F.lit("all")), ("by_severity", F.col("severity")), ("by_farm", F.col("farm")), ("daily_count", F.col("day"))]
    parts = [
        rows.groupBy(F.lit(s).alias("section"), k.alias("key")).agg(F.sum(COUNT).alias("alerts")) for s, k in sections
    ]
    return reduce(DataFrame.unionByName, parts).where("key <> 'none' or section <> 'daily_count'")


def log_levels(rows: DataFrame) -> DataFrame:
    """Section, key and value (D6): records in total and per level, loggers, first and last time."""
    small = rows.groupBy("level", "logger").agg(F.sum(COUNT).alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))

    def part(section: str, key: Column, value: Column, *by: str) -> DataFrame:
        return small.groupBy(*by).agg(value.alias("_v")).select(F.lit(section).alias("section"), key.cast("string").alias("key"), F.col("_v").cast("string").alias("value"))

    stamp = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return reduce(DataFrame.unionByName, [
        part("total", F.lit("total_logs"), F.coalesce(F.sum("n"), F.lit(0))),
        part("time_range", F.lit("first"), F.date_format(F.min("first"), stamp)),
        part("time_range", F.lit("last"), F.date_format(F.max("last"), stamp)),
        part("level_distribution", F.col("level"), F.sum("n"), "level"),
        part("unique_loggers", F.col("logger"), F.lit(1), "logger"),
    ])


def errors_by_message(rows: DataFrame, levels: tuple[str, ...] = ("ERROR", "CRITICAL")) -> DataFrame:
    """Records of level ERROR or above per message (D7)."""
    return rows.where(F.col("level").isin(*levels)).groupBy(F.coalesce("message", F.lit("Unknown")).alias("key")).agg(F.sum(COUNT).alias("errors"))


def summary(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Animals, rows, anomalies and farms (D1) of rollup rows and bitmaps of the same days."""
    farms = rows.where("farm_id is not null").select("farm_id").distinct()
    return rows.agg(
        F.coalesce(F.sum(COUNT), F.lit(0)).alias("total_records"), F.coalesce(F.sum("anomalies"), F.lit(0)).alias("anomaly_count")
    ).select(
        distinct_animals(sets).scalar().alias("total_animals"), "total_records", "anomaly_count",
        farms.agg(F.count("*")).scalar().alias("farms_monitored"),
    )


def type_shares(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Records per animal type, in percent of animals and of records (D9)."""
    animals, records = distinct_animals(sets).scalar(), rows.agg(F.sum(COUNT)).scalar()
    return rows.where("animal_type is not null").groupBy("animal_type").agg(F.sum(COUNT).alias("records")).withColumns({
        "pct_of_animals": F.col("records") / animals * 100, "pct_of_records": F.col("records") / records * 100,
    })


def daily_figures(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Section, key and value (D14): totals, advice, and animals per type; animals are counted per type once."""
    total = summary(rows, sets)
    share = F.format_string("%.1f%%", F.col("anomaly_count") / F.col("total_records") * 100)
    pairs = [
        ("summary", "total_animals", F.col("total_animals")), ("summary", "total_records", F.col("total_records")),
        ("summary", "farms_monitored", F.col("farms_monitored")), ("anomalies", "anomaly_count", F.col("anomaly_count")),
        ("anomalies", "anomaly_rate", share), ("recommendations", "advice", daily_advice(F.col("anomaly_count"))),
    ]
    lines = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(k).alias("key"), v.cast("string").alias("value")) for s, k, v in pairs])
    types = distinct_animals(sets, "animal_type").select(
        F.lit("animals_by_type").alias("section"), F.initcap("animal_type").alias("key"), F.col("total_animals").cast("string").alias("value")
    )
    return total.select(F.inline(lines)).unionByName(types)


def herd_figures(livestock: DataFrame) -> DataFrame:
    """Active animals in total and per type, and farms (D4), by way of one row per type and farm."""
    small = livestock.where("is_active").groupBy("animal_type", "farm_id").agg(F.count("*").alias("n"))
    types = small.groupBy("animal_type").agg(F.sum("n").alias("animals")).select(
        F.lit("by_type").alias("section"), F.coalesce("animal_type", F.lit("unknown")).alias("animal_type"), "animals", F.lit(None).cast("long").alias("farms")
    )
    farms = small.groupBy("farm_id").agg(F.sum("n").alias("n"))
    total = farms.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("animals"), F.count("*").alias("farms")).select(
        F.lit("total").alias("section"), F.lit(None).cast("string").alias("animal_type"), "animals", "farms"
    )
    return types.unionByName(total)
