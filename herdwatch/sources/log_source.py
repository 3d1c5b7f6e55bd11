"""Log files as a data source: ``spark.read.format("herd_logs").load(folder)``.

A folder of text logs, current (.log, .txt) or rotated (.gz), becomes a table of records. Conditions on time and level
reach the source: a file whose path names a day outside the wanted times is not opened, and records are compared
before they leave Python. Plain files are cut into ranges of bytes, so that one large file is read by several tasks;
a line belongs to the range it starts in.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

from ..operators.logs import RECORD_PATTERN

NAME = "herd_logs"
SCHEMA = "timestamp timestamp, level string, logger string, message string, operation string, duration_ms double"
RANGE_BYTES, ROWS = 64 << 20, 8_192
DAY = re.compile(r"(\d{4}-\d{2}-\d{2})")
INSIDE = re.compile(RECORD_PATTERN)
ENDINGS = (".log", ".txt", ".gz", ".json")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if re.match(r"file:/(?!/)", path) else path)
    return pafs.LocalFileSystem(), path


def as_time(value) -> datetime | None:
    """A time in UTC; what is no time is None."""
    if isinstance(value, datetime):
        return value if value.tzinfo else value.replace(tzinfo=timezone.utc)
    try:
        found = datetime.fromisoformat(str(value))
    except ValueError:
        return None
    return found if found.tzinfo else found.replace(tzinfo=timezone.utc)


def as_text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def record_of(line: str) -> dict | None:
    """The record a line is, or the one inside it; None without any."""
    text = line.strip()
    tries = [text] if text.startswith("{") else []
    inside = INSIDE.search(line)
    for found in [*tries, *([inside[0]] if inside else [])]:
        try:
            record = json.loads(found)
        except ValueError:
            continue
        if isinstance(record, dict) and record:
            return record
    return None


@dataclass
class Bounds:
    """Wanted times and levels; None wants all."""

    since: datetime | None = None
    until: datetime | None = None
    levels: frozenset[str] | None = None
    # Whether the ends themselves are wanted.
    with_since: bool = True
    with_until: bool = True

    def raise_since(self, value: datetime, inclusive: bool) -> None:
        if self.since is None or value > self.since or (value == self.since and not inclusive):
            self.since, self.with_since = value, inclusive

    def lower_until(self, value: datetime, inclusive: bool) -> None:
        if self.until is None or value < self.until or (value == self.until and not inclusive):
            self.until, self.with_until = value, inclusive

    def keep_levels(self, values: Iterable[str]) -> None:
        self.levels = frozenset(values) if self.levels is None else self.levels & frozenset(values)

    def want_file(self, path: str) -> bool:
        """Whether a file may hold wanted records; one without a day in its path may."""
        named = DAY.findall(path)
        try:
            first = datetime.fromisoformat(named[-1]).replace(tzinfo=timezone.utc) if named else None
        except ValueError:
            first = None
        if first is None:
            return True
        return not (self.since is not None and first + timedelta(days=1) <= self.since) and not (self.until is not None and first > self.until)

    def want(self, time: datetime | None, level: str | None) -> bool:
        if self.levels is not None and level not in self.levels:
            return False
        if self.since is None and self.until is None:
            return True
        if time is None:
            return False
        if self.since is not None and (time < self.since or (time == self.since and not self.with_since)):
            return False
        return self.until is None or time < self.until or (time == self.until and self.with_until)


class LogRange(InputPartition):
    """Bytes ``start`` to ``end`` of a file; ``end`` None reads a compressed file as a whole."""

    def __init__(self, path: str, start: int, end: int | None):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


def lines(part: LogRange) -> Iterator[bytes]:
    files, path = opened(part.path)
    if part.end is None:
        # The name tells whether it is compressed.
        with files.open_input_stream(path, compression="detect") as stream:
            yield from _split(stream, None)
        return
    with files.open_input_file(path) as file:
        at = part.start
        if at:
            # A line that starts before this range belongs to the one before.
            file.seek(at - 1)
            at += len(_until_newline(file)) - 1
        if at < part.end:
            file.seek(at)
            yield from _split(file, part.end - at)


def _until_newline(file) -> bytes:
    out = b""
    while True:
        piece = file.read(1 << 16)
        cut = piece.find(b"\n")
        if not piece or cut >= 0:
            return out + (piece[: cut + 1] if cut >= 0 else piece)
        out += piece


def _split(file, size: int | None) -> Iterator[bytes]:
    """Lines that start within the next ``size`` bytes."""
    rest, at = b"", 0
    while True:
        piece = file.read(1 << 20)
        parts = (rest + piece).split(b"\n")
        rest = parts.pop()
        for line in parts:
            if size is not None and at >= size:
                return
            yield line
            at += len(line) + 1
        if not piece:
            if rest and (size is None or at < size):
                yield rest
            return
        if size is not None and at >= size:
            return


class LogReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.options, self.schema = options, schema
        self.bounds = Bounds()
        for name, put in (("since", self.bounds.raise_since), ("until", self.bounds.lower_until)):
            if options.get(name):
                value = as_time(options[name])
                if value is None:
                    raise ValueError(f"{name} is no time: {options[name]}")
                put(value, True)
        if options.get("level"):
            self.bounds.keep_levels(options["level"].split(","))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes conditions on time and level; Spark applies the others."""
        for condition in filters:
            column = getattr(condition, "attribute", None)
            if column == ("timestamp",) and isinstance(condition, (GreaterThan, GreaterThanOrEqual)):
                self.bounds.raise_since(as_time(condition.value), isinstance(condition, GreaterThanOrEqual))
            elif column == ("timestamp",) and isinstance(condition, (LessThan, LessThanOrEqual)):
                self.bounds.lower_until(as_time(condition.value), isinstance(condition, LessThanOrEqual))
            elif column == ("level",) and isinstance(condition, EqualTo):
                self.bounds.keep_levels([condition.value])
            elif column == ("level",) and isinstance(condition, In):
                self.bounds.keep_levels(v for v in condition.value if v is not None)
            else:
                yield condition

    def partitions(self) -> list[LogRange]:
        root = self.options["path"]
        files, path = opened(root)
        prefix = root[: len(root) - len(path)] if root.endswith(path) else "file://"
        size = int(self.options.get("rangebytes", RANGE_BYTES))
        out = []
        for entry in files.get_file_info(pafs.FileSelector(path, recursive=True)):
            hidden = any(p.startswith(("_", ".")) for p in entry.path[len(path) :].split("/") if "=" not in p)
            if entry.type != pafs.FileType.File or hidden or not entry.path.endswith(ENDINGS) or not self.bounds.want_file(entry.path[len(path) :]):
                continue
            name = prefix + entry.path
            if entry.path.endswith(".gz"):
                out.append(LogRange(name, 0, None))
            else:
                out += [LogRange(name, at, min(at + size, entry.size)) for at in range(0, entry.size, size)]
        return out or [LogRange("", 0, 0)]

    def read(self, partition: LogRange) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        names = self.schema.names
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for line in lines(partition) if partition.path else ():
            record = record_of(line.decode("utf-8", "replace"))
            if record is None:
                continue
            time = None if record.get("timestamp") is None else as_time(record["timestamp"])
            level = as_text(record.get("level"))
            if not self.bounds.want(time, level):
                continue
            row = {"timestamp": time, "level": level, "duration_ms": _number(record.get("duration_ms"))}
            held.append(tuple(row[n] if n in row else as_text(record.get(n)) for n in names))
            if len(held) == ROWS:
                yield batch()
                held.clear()
        if held:
            yield batch()


def _number(value) -> float | None:
    try:
        return None if value is None or isinstance(value, bool) else float(value)
    except (TypeError, ValueError):
        return None


class LogSource(DataSource):
    """Options: since, until (times), level (comma-separated), rangeBytes; the same can be said by filters."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> LogReader:
        return LogReader({k.lower(): v for k, v in self.options.items()}, schema)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with conditions passed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LogSource)
