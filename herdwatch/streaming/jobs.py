"""Streaming forms of ingest, validation, clustering, z-scores and upsert.

All jobs take a streaming DataFrame with ``date`` as timestamp and return the started query.
``once=True`` processes what is there and stops.

Spark drops rows behind the watermark without a trace. ``flag_late`` marks them before they reach such a job, so that
they can be kept in a folder of their own; ``Accounts`` adds up what the jobs report about their rows.
"""

from __future__ import annotations

import threading
from collections import Counter
from collections.abc import Iterator, Sequence
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery, StreamingQueryListener

from ..constants import METRICS
from ..operators.contracts import Contract
from ..operators.detect import ZERO_SPREAD
from ..operators.rules import split_valid
from ..operators.storage import save_metrics
from ..sources.writers import STAMPS

# Files of one micro-batch, so that a backlog is not one batch.
FILES_PER_BATCH = 1000
# The time of rows without one: before all others.
NO_TIME = -(1 << 62)
# The group of rows without an animal.
NO_ANIMAL = -1


def read_files(
    spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = FILES_PER_BATCH, **options: str
) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.schema(schema).format(fmt).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.load(path)


def _start(writer, checkpoint: str, once: bool, interval: str) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def _to_parquet(stream: DataFrame, path: str, checkpoint: str, once: bool, interval: str) -> StreamingQuery:
    return _start(stream.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint, once, interval)


def dedup(
    readings: DataFrame, path: str, checkpoint: str, *, keys: Sequence[str] = ("tag_id", "date"),
    delay: str = "7 days", once: bool = True, interval: str = "1 minute",
) -> StreamingQuery:
    """Append each (animal, date) once; copies within the delay are dropped."""
    unique = readings.withWatermark("date", delay).dropDuplicatesWithinWatermark(list(keys))
    unique = unique.observe("rows", F.count("*").alias("out"))
    return _to_parquet(unique, path, checkpoint, once, interval)


def validate(
    rows: DataFrame, contract: Contract, good: str, bad: str, checkpoint: str, *, once: bool = True,
    interval: str = "1 minute",
) -> StreamingQuery:
    """Split every micro-batch into valid rows and quarantined ones (with their errors).

    Each batch writes its own folder, so a repeated batch replaces what it wrote before.
    """

    def split(batch: DataFrame, batch_id: int) -> None:
        valid, invalid = split_valid(batch, contract)
        valid.write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
        invalid.write.mode("overwrite").parquet(f"{bad}/batch={batch_id}")

    return _start(rows.writeStream.foreachBatch(split), checkpoint, once, interval)


def outbreak_clusters(flagged: DataFrame, *, window: str = "7 days", delay: str = "1 day", min_cluster_size: int = 3) -> DataFrame:
    """Streaming clusters of flagged readings per farm and window, emitted when the window closes.

    A first aggregation per animal makes the number of animals exact. Rows later than the
    watermark are dropped.
    """
    per_animal = (
        flagged.filter(F.col("is_anomaly") & F.col("farm_id").isNotNull())
        .withWatermark("date", delay)
        .groupBy(F.window("date", window).alias("w"), "farm_id", "tag_id")
        .agg(
            F.count("*").alias("rows"),
            F.sum("anomaly_score").alias("score"),
            F.count("anomaly_score").alias("scored"),
            F.max("animal_type").alias("animal_type"),
        )
    )
    per_farm = per_animal.groupBy(F.window("w", window).alias("w"), "farm_id").agg(
        F.sum("rows").alias("anomaly_rows"),
        F.count("*").alias("affected_animals"),
        (F.sum("score") / F.sum("scored")).alias("avg_anomaly_score"),
        F.array_sort(F.collect_set("animal_type")).alias("animal_types"),
    )
    return per_farm.filter(F.col("anomaly_rows") >= min_cluster_size).select(
        "farm_id", F.col("w.start").alias("start_date"), F.col("w.end").alias("end_date"), "anomaly_rows",
        "affected_animals", "avg_anomaly_score", "animal_types",
    )


def clusters(
    flagged: DataFrame, path: str, checkpoint: str, *, once: bool = True, interval: str = "1 minute", **options
) -> StreamingQuery:
    return _to_parquet(outbreak_clusters(flagged, **options), path, checkpoint, once, interval)


class RollingScores(StatefulProcessor):
    """Holds the readings of a group of animals until the watermark has passed them, then scores them in the order of their time.

    Readings wait in pieces of time, one state entry each; a timer at the end of a piece lets it out. Only one
    piece of one group is in memory at a time, however large a backlog is. A reading of a piece that
    is out already for its animal is late: it is passed on unscored.
    """

    def __init__(self, keep: Sequence[str], metrics: Sequence[str], window_size: int, piece: int):
        self.keep, self.metrics, self.size, self.piece = list(keep), list(metrics), window_size, piece

    def init(self, handle) -> None:
        self.handle = handle
        # The last values of one animal after another; the animals, their numbers of values, and up to when their pieces are out.
        self.last = handle.getValueState("last", T.StructType([T.StructField(m, T.ArrayType(T.DoubleType())) for m in self.metrics]))
        self.animals = handle.getValueState("animals", "rows binary")
        self.waiting = handle.getMapState("waiting", "piece long", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        done = self._animals()
        for chunk in rows:
            until = np.full(len(chunk), NO_TIME + 1)
            if done is not None:
                at = np.zeros(len(chunk), int) if key[0] == NO_ANIMAL else pd.Index(done["tag_id"]).get_indexer(chunk["tag_id"])
                until = np.where(at >= 0, done["done"].to_numpy()[at], until)
            late = chunk["time_us"].to_numpy() < until
            if late.any():
                out = chunk.loc[late, self.keep].assign(**{f"{m}_zscore": np.nan for m in self.metrics})
                yield out.assign(late=True)
                chunk = chunk[~late]
            pieces = (chunk["time_us"] // self.piece).to_numpy()
            order = np.argsort(pieces, kind="stable")
            table = pa.Table.from_pandas(chunk[[*self.keep, *self.metrics, "time_us"]].iloc[order], preserve_index=False)
            found, starts, sizes = np.unique(pieces[order], return_index=True, return_counts=True)
            for piece, start, n in zip(found.tolist(), starts.tolist(), sizes.tolist(), strict=True):
                self._hold(piece, table.slice(start, n))

    def _hold(self, piece: int, part: pa.Table) -> None:
        if self.waiting.containsKey((piece,)):
            # A column without values in one part has another type there.
            part = pa.concat_tables([_unpacked(self.waiting.getValue((piece,))[0]), part], promote_options="permissive")
        else:
            self.handle.registerTimer((piece + 1) * self.piece // 1000)
        self.waiting.updateValue((piece,), (_packed(part),))

    def _animals(self) -> pd.DataFrame | None:
        return _unpacked(self.animals.get()[0]).to_pandas() if self.animals.exists() else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        for piece in sorted(k[0] for k in self.waiting.keys() if (k[0] + 1) * self.piece <= until):
            held = _unpacked(self.waiting.getValue((piece,))[0]).to_pandas()
            held = held.sort_values(["time_us", *[c for c in self.keep if c != "tag_id"]])
            out, sizes = self._scored(held, self._animals())
            yield out
            self.animals.update((_packed(self._let_out(sizes, held["tag_id"], (piece + 1) * self.piece)),))
            self.waiting.removeKey((piece,))

    def _scored(self, new: pd.DataFrame, animals: pd.DataFrame | None = None) -> tuple[pd.DataFrame, pd.DataFrame]:
        """(scores of a piece, numbers of values by animal); the last values of each animal are kept."""
        series = new[["tag_id", *self.metrics]]
        if animals is not None:
            past = {m: np.array(x, dtype=float) for m, x in zip(self.metrics, self.last.get(), strict=True)}
            series = pd.concat([pd.DataFrame({"tag_id": np.repeat(animals["tag_id"].to_numpy(), animals["n"]), **past}), series], ignore_index=True)
        animal, tags = pd.factorize(series["tag_id"], use_na_sentinel=False)
        order = np.argsort(animal, kind="stable")
        animal, back = animal[order], np.argsort(order, kind="stable")[len(series) - len(new):]
        kept = np.searchsorted(animal, animal, side="right") - np.arange(len(animal)) < self.size
        out, state = new[self.keep].copy(), []
        for metric in self.metrics:
            values = series[metric].to_numpy(dtype=float)[order]
            out[f"{metric}_zscore"] = trailing_zscore(values, self.size, animal)[back]
            state.append([None if np.isnan(x) else x for x in values[kept].tolist()])
        self.last.update(tuple(state))
        sizes = pd.DataFrame({"tag_id": tags, "n": np.bincount(animal[kept], minlength=len(tags))})
        if animals is not None and self.size == 1:
            # Animals without a value are not among the series.
            sizes = pd.concat([animals[["tag_id", "n"]], sizes]).drop_duplicates("tag_id")
        return out.assign(late=False), sizes

    def _let_out(self, sizes: pd.DataFrame, tags: pd.Series, until: int) -> pa.Table:
        before = self._animals()
        done = np.full(len(sizes), NO_TIME + 1)
        if before is not None:
            at = pd.Index(before["tag_id"]).get_indexer(sizes["tag_id"])
            done = np.where(at >= 0, before["done"].to_numpy()[at], done)
        done = np.where(sizes["tag_id"].isin(tags), until, done)
        return pa.Table.from_pandas(sizes.assign(done=done), preserve_index=False)

    def close(self) -> None:
        pass


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    with pa.ipc.open_stream(bytes(data)) as reader:
        return reader.read_all()


def trailing_zscore(values: np.ndarray, size: int, series: np.ndarray | None = None) -> np.ndarray:
    """z-score of each value within the last ``size`` values up to it; missing values are left out.

    ``series`` numbers the series that the values belong to, each of which lies together.
    """
    padded = np.concatenate([np.full(size - 1, np.nan), values])
    frames = np.lib.stride_tricks.sliding_window_view(padded, size)
    known = ~np.isnan(frames)
    if series is not None:
        known &= np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(size - 1, -1), series]), size) == series[:, None]
    n = known.sum(axis=1)
    total = np.where(known, frames, 0.0)
    mean = total.sum(axis=1) / np.maximum(n, 1)
    squares = np.where(known, frames - mean[:, None], 0.0) ** 2
    spread = np.sqrt(squares.sum(axis=1) / np.maximum(n - 1, 1))
    ok = (n > 1) & (spread > ZERO_SPREAD)
    return np.where(ok, (values - mean) / np.where(ok, spread, 1.0), np.nan)


def rolling_scores(
    readings: DataFrame, path: str, checkpoint: str, *, keep: Sequence[str] = ("date", "arrival_id"),
    metrics: Sequence[str] = METRICS, window_size: int = 7, delay: str = "7 days", piece_hours: int = 24, spread: int = 512,
    once: bool = True, interval: str = "1 minute",
) -> StreamingQuery:
    """Rolling z-scores per animal by the time of the readings, in whatever order they arrive.

    Readings may come up to ``delay`` behind the newest one. A piece of ``piece_hours`` is scored when the
    watermark has passed it, so the result is that of the batch operator over all readings in time.
    Later ones are written with ``late`` = true and without scores, as are rows without a date; ``path`` has a folder for
    either kind. Animals share their state in ``spread`` groups, which stays the same for a checkpoint; a task holds a piece of
    one group at a time. Rows without an animal only move the watermark (see ``tick``).
    """
    kinds = dict(readings.dtypes)
    columns = ["tag_id", *keep]
    schema = ", ".join([f"{c} {kinds[c]}" for c in columns] + [f"{m}_zscore double" for m in metrics] + ["late boolean"])
    # The time as a plain number: Spark itself drops no row for being late. (Names from "_" on do not reach the processor.)
    time = F.coalesce(F.unix_micros("date"), F.lit(NO_TIME)).alias("time_us")
    # A condition on the date stays above the watermark, so that rows without an animal move it.
    named = F.col("tag_id").isNotNull() | (F.col("date") < F.lit("0001-01-02").cast("timestamp"))
    plain = readings.withWatermark("date", delay).where(named).select(
        *[(F.timestamp_micros(F.unix_micros("date")) if c == "date" else F.col(c)).alias(c) for c in columns], *metrics, time
    )
    processor = RollingScores(columns, metrics, window_size, piece_hours * 3_600_000_000)
    group = F.when(F.col("tag_id").isNull(), NO_ANIMAL).otherwise(F.pmod(F.xxhash64("tag_id"), F.lit(spread))).cast("long")
    scored = (
        plain.withColumn("part", group).groupBy("part")
        .transformWithStateInPandas(processor, schema, "Append", "EventTime")
    )
    clean = scored.withColumns(
        {f"{m}_zscore": F.when(~F.isnan(f"{m}_zscore"), F.col(f"{m}_zscore")) for m in metrics}
    )
    counted = clean.observe("rows", F.count("*").alias("out"), F.count_if("late").alias("late"))
    writer = counted.writeStream.format("parquet").option("path", path).outputMode("append").partitionBy("late")
    return _start(writer, checkpoint, once, interval)


def tick(spark: SparkSession, path: str, schema, at: datetime) -> None:
    """Adds a file with nothing but a time: readings from ``delay`` before it and earlier are complete."""
    shape = spark.createDataFrame([], schema).schema
    row = tuple(at if f.name == "date" else None for f in shape)
    free = T.StructType([T.StructField(f.name, f.dataType) for f in shape])
    spark.createDataFrame([row], free).write.mode("append").parquet(path)


class LateFlags(StatefulProcessor):
    """Marks rows that are not after the watermark; keeps no state."""

    def init(self, handle) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for chunk in rows:
            late = (chunk["time_us"] <= mark * 1000) if mark > 0 else np.zeros(len(chunk), bool)
            yield pd.DataFrame({"row": chunk["row"], "late": np.asarray(late, bool)})

    def close(self) -> None:
        pass


def flag_late(rows: DataFrame, path: str, checkpoint: str, *, delay: str = "7 days", spread: int = 64, once: bool = True, interval: str = "1 minute") -> StreamingQuery:
    """Writes all rows to ``path``, those more than ``delay`` behind earlier batches to its folder late=true.

    Stateful jobs read the others by ``on_time`` with the same delay, and then drop none. Rows travel as JSON
    texts, which keep all types; ``spread`` groups share the work, whatever the keys are. Rows without a date are not late.
    """
    schema = rows.schema
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), STAMPS)
    # A time without the watermark's mark, so that Spark passes on every row.
    flat = rows.withWatermark("date", delay).select(text.alias("row"), F.coalesce(F.unix_micros("date"), F.lit(1 << 62)).alias("time_us"))
    flagged = (
        flat.withColumn("_part", F.pmod(F.xxhash64("row"), F.lit(spread))).groupBy("_part")
        .transformWithStateInPandas(LateFlags(), "row string, late boolean", "Append", "EventTime")
    )
    out = flagged.select(F.from_json("row", schema, STAMPS).alias("r"), "late").select("r.*", "late")
    counted = out.observe("rows", F.count("*").alias("out"), F.count_if("late").alias("late"))
    writer = counted.writeStream.format("parquet").option("path", path).outputMode("append").partitionBy("late")
    return _start(writer, checkpoint, once, interval)


def read_flagged(spark: SparkSession, path: str) -> DataFrame:
    """What ``flag_late`` or ``rolling_scores`` has written, as a table with ``late`` as a boolean."""
    return spark.read.parquet(path).withColumn("late", F.col("late").cast("boolean"))


def on_time(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows that ``flag_late`` did not mark, as a stream; a batch of it is taken as a whole."""
    both = T.StructType([*schema.fields, T.StructField("late", T.BooleanType())])
    return read_files(spark, path, both, files_per_batch=None).where("not late").drop("late")


class Accounts(StreamingQueryListener):
    """What queries report about their rows, added up over micro-batches by the query's id.

    ``rows[id]`` counts rows read (``in``), copies that deduplication dropped (``copies``), rows that Spark dropped behind
    the watermark (``dropped``) and whatever a job observes about its output (``out``, ``late``).
    """

    def __init__(self) -> None:
        self.rows: dict[str, Counter] = {}
        self.ended: dict[str, threading.Event] = {}

    def _end(self, run) -> threading.Event:
        return self.ended.setdefault(str(run), threading.Event())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        count = self.rows.setdefault(str(progress.id), Counter())
        count["in"] += max(progress.numInputRows, 0)
        for state in progress.stateOperators:
            count["dropped"] += state.numRowsDroppedByWatermark
            count["copies"] += int(state.customMetrics.get("numDroppedDuplicateRows", 0))
        for row in progress.observedMetrics.values():
            for name, value in row.asDict().items():
                count[name] += value or 0

    def onQueryTerminated(self, event) -> None:
        self._end(event.runId).set()

    def of(self, query: StreamingQuery, timeout: float = 60) -> Counter:
        """The counts of a query that has ended, once its last report is in."""
        self._end(query.runId).wait(timeout)
        return self.rows.get(str(query.id), Counter())


def upsert_readings(
    readings: DataFrame, table: str, checkpoint: str, *, keys: Sequence[str] = ("tag_id", "date"),
    arrival: str | None = "arrival_id", once: bool = True, interval: str = "1 minute",
) -> StreamingQuery:
    """Upsert every micro-batch into the stored readings as one version each.

    The version notes the checkpoint and the batch's number, so that a repeated batch makes no new version.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            save_metrics(batch, table, keys, arrival, writer=(checkpoint, batch_id))

    return _start(readings.writeStream.foreachBatch(write), checkpoint, once, interval)
