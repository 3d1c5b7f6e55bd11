"""The log source gives the records of the parser, whatever the files are, and opens no file it need not."""

import gzip
import json
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from herdwatch.operators import logs as lg
from herdwatch.sources import log_source

FIELDS = ["timestamp", "level", "logger", "message", "operation", "duration_ms"]


def line(day, i, level="INFO", **more):
    return json.dumps({"timestamp": f"2024-01-{day:02d}T{i % 24:02d}:00:00.000123Z", "level": level, "logger": "m", "message": f"ä {i}", "operation": "op", "duration_ms": i / 2, **more})


ODD = ["", "plain text", "{broken", "{}", "[worker] " + line(3, 5, "ERROR") + " tail", "  " + line(3, 6), line(3, 7, None), json.dumps({"message": "no time", "duration_ms": "x"}), "[1, 2]", line(3, 8, "WARNING", duration_ms="7.5")]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    for day in (1, 2, 3):
        text = [line(day, i, ["INFO", "ERROR", "DEBUG"][i % 3]) for i in range(40)] + (ODD if day == 3 else [])
        (root / f"app-2024-01-{day:02d}.log").write_text("\n".join(text) + ("\n" if day == 1 else ""), encoding="utf-8")
    with gzip.open(root / "app-2024-01-04.log.gz", "wt", encoding="utf-8") as file:
        file.write("\n".join(line(4, i) for i in range(10)))
    (root / "current.log").write_text(line(9, 1, "CRITICAL") + "\n")
    (root / "_temporary.log").write_text(line(9, 2) + "\n")
    (root / "notes.md").write_text(line(9, 3) + "\n")
    return root


def load(spark, folder, **options):
    log_source.register(spark)
    return spark.read.format("herd_logs").options(**options).load(str(folder))


def parsed(spark, folder):
    names = [str(p) for p in sorted(folder.iterdir()) if p.name.startswith(("app", "current"))]
    return lg.parse_lines(spark.read.text(names).withColumnRenamed("value", "line")).select(*FIELDS)


@pytest.mark.parametrize("size", [64 << 20, 1000, 37])
def test_same_records_as_the_parser(spark, folder, size):
    got = load(spark, folder, rangeBytes=size)
    assert got.columns == FIELDS and rows(got) == rows(parsed(spark, folder))


def test_conditions_reach_the_source(spark, folder):
    want = parsed(spark, folder)
    for condition in (
        (F.col("timestamp") >= "2024-01-02 05:00:00") & (F.col("timestamp") < "2024-01-03 07:00:00"), F.col("level") == "ERROR",
        F.col("level").isin("ERROR", "CRITICAL") & (F.col("timestamp") > "2024-01-03 05:00:00.000123"), F.col("level").isNull(),
        (F.col("duration_ms") > 3) & (F.col("timestamp") <= "2024-01-01 04:00:00.000123"),
    ):
        assert rows(load(spark, folder).where(condition)) == rows(want.where(condition))
    some = load(spark, folder, since="2024-01-02 05:00:00", until="2024-01-03T06:00:00Z", level="ERROR,WARNING")
    assert rows(some) == rows(want.where("timestamp >= '2024-01-02 05:00:00' and timestamp <= '2024-01-03 06:00:00' and level in ('ERROR', 'WARNING')"))


def test_files_outside_the_times_are_not_opened(spark, folder, tmp_path):
    """Files of other days that cannot be read: only a query that wants their days fails."""
    for p in folder.iterdir():
        (tmp_path / p.name).write_bytes(p.read_bytes())
    (tmp_path / "app-2024-01-01.log.gz").write_bytes(b"no gzip at all")
    nested = tmp_path / "day=2024-01-05"
    nested.mkdir()
    (nested / "part.gz").write_bytes(b"neither")
    wanted = (F.col("timestamp") >= "2024-01-02") & (F.col("timestamp") < "2024-01-04")
    assert load(spark, tmp_path).where(wanted).count() == parsed(spark, folder).where(wanted).count()
    assert load(spark, tmp_path, since="2024-01-02", until="2024-01-04 23:00:00").count() > 0
    with pytest.raises(Exception, match="(?i)gzip|zlib|inflate|header"):
        load(spark, tmp_path).count()


def test_ranges_of_a_file_are_tasks_of_their_own(folder):
    reader = log_source.LogReader({"path": str(folder), "rangebytes": "1000"}, None)
    parts = reader.partitions()
    first = [p for p in parts if "01-01" in p.path]
    assert len(first) > 3 and [p.start for p in first] == list(range(0, 1000 * len(first), 1000))
    found = [ln for p in first for ln in log_source.lines(p)]
    assert found == (folder / "app-2024-01-01.log").read_bytes().splitlines()


def test_an_empty_folder_has_no_records(spark, tmp_path):
    assert load(spark, tmp_path).count() == 0
    with pytest.raises(Exception, match="no time"):
        load(spark, tmp_path, since="yesterday").count()


def test_bounds_narrow():
    bounds = log_source.Bounds()
    bounds.raise_since(log_source.as_time("2024-01-02"), True)
    bounds.raise_since(log_source.as_time("2024-01-02"), False)
    bounds.raise_since(log_source.as_time("2024-01-01"), True)
    assert not bounds.want(datetime(2024, 1, 2, tzinfo=log_source.timezone.utc), None)
    assert not bounds.want_file("x/2024-01-01.log") and bounds.want_file("x/2024-01-02.log") and bounds.want_file("x/9999-99-99.log")
