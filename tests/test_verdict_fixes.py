"""Cases that once went wrong: plain sessions, null dates, repeated days, NaN, odd values of contracts."""

import datetime
import subprocess
import sys

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from herdwatch.functions.scalars import parse_date, size_text
from herdwatch.operators import clean, contracts, iforest, joins, seasonal, storage

PLAIN = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
import __spark_entry__ as entry
assert entry.entry(spark).columns
for name in ("rolling_zscore", "clean_all", "contract_summary", "dq_basic", "metrics_summary", "upsert_metrics", "log_parse", "iqr_outliers"):
    assert entry.queries()[name](spark, {data!r}).count() > 0, name
print("plain session works")
"""


def test_queries_run_on_a_plain_session(data):
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", PLAIN.format(root=root, data=data)], capture_output=True, text=True, timeout=600)
    assert "plain session works" in done.stdout, done.stderr[-2000:]


def test_upsert_keeps_and_matches_null_dates(spark, tmp_path):
    path, day = str(tmp_path / "metrics"), datetime.datetime(2024, 1, 1)
    schema = "tag_id long, date timestamp, temperature double"
    storage.create_metrics(spark.createDataFrame([(1, day, 38.0), (1, None, 1.0), (2, None, 2.0)], schema), path)
    batch = spark.createDataFrame([(1, None, 9.0), (3, day, 39.0)], schema)
    want = {(1, day, 38.0), (1, None, 9.0), (2, None, 2.0), (3, day, 39.0)}
    for _ in range(2):
        storage.save_metrics(batch, path)
        assert {tuple(r) for r in storage.read_metrics(spark, path).collect()} == want


def test_upsert_matches_null_keys(spark):
    old = spark.createDataFrame([(None, 1), (2, 2)], "k int, v int")
    new = spark.createDataFrame([(None, 5), (3, 3)], "k int, v int")
    assert {tuple(r) for r in joins.upsert(old, new, ["k"]).collect()} == {(None, 5), (2, 2), (3, 3)}


def test_repeated_days_raise(spark):
    days = [(datetime.date(2024, 1, 1) + datetime.timedelta(d), float(d)) for d in range(21)]
    df = spark.createDataFrame([*days, days[4]], "day date, value double")
    with pytest.raises(PySparkException, match="several rows for one day"):
        seasonal.decompose(df, "value").collect()
    assert seasonal.decompose(df.distinct(), "value").count() == 21


def test_nan_is_a_missing_value(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 100)] + [(float("nan"),)], "x double")
    assert clean.iqr_outliers(df, "x").count() == 0
    typed = clean.fix_types(spark.createDataFrame([("NaN",), ("1.5",)], "temperature string"))
    assert [r[0] for r in typed.collect()] == [None, 1.5]
    filled = clean.impute_mean(spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "temperature double"))
    assert sorted(r[0] for r in filled.collect()) == [1.0, 2.0, 3.0]


def test_dates_without_leading_zeros(spark):
    df = spark.createDataFrame([("2024-1-5",), ("5/1/2024",), ("2024-01-05 1:02:03",), ("12/25/2024",), ("2024-13-45",), ("x",)], "t string")
    assert [r[0] for r in df.select(parse_date("t").isNotNull()).collect()] == [True] * 4 + [False] * 2


@pytest.mark.parametrize(
    ("value", "kind", "rule", "code"),
    [
        ("1e20", "string", dict(kind="integer"), 0),
        ("1.5", "string", dict(kind="integer"), 2),
        ("Infinity", "string", dict(kind="integer"), 2),
        (1234, "int", dict(kind="string", pattern="[A-Z]+"), 2),
        (1234, "int", dict(kind="string", pattern=r"\d{4}$"), 0),
        (7, "int", dict(kind="string", allowed=("7", "8")), 0),
        (9, "int", dict(kind="string", allowed=("7", "8")), 2),
        ("2024-1-5", "string", dict(kind="datetime"), 0),
    ],
)
def test_contract_verdicts(spark, value, kind, rule, code):
    df = spark.createDataFrame([(value,)], f"c {kind}")
    assert df.select(contracts.severity_code(contracts.ColumnRule(name="c", **rule), kind)).first()[0] == code


@pytest.mark.parametrize("rows", [40, 5_000])
def test_samples_follow_one_scheme(spark, rows):
    df = spark.range(rows).select("id", F.rand(1).alias("a"))
    scaling = {"a": {"mean": 0.0, "scale": 1.0, "reach": 1.0}}
    counts = {r["tree"]: r["count"] for r in iforest._samples(df, rows, ["id"], ["a"], scaling, 20, 32, 3).groupBy("tree").count().collect()}
    assert counts == dict.fromkeys(range(20), 32)


def test_size_text_rounds_ties_to_even(spark):
    sizes = spark.createDataFrame([(0,), (1023,), (800000,), (160000,), (5 * 1024**3,)], "size long")
    got = [r[0] for r in sizes.select(size_text("size")).collect()]
    assert got == ["0 B", "1023.0 B", "781.2 KB", "156.2 KB", "5.0 GB"]


def test_whole_table_fingerprint_sees_a_changed_time(spark, data, tmp_path):
    import __spark_entry__ as entry

    run = entry.queries()["whole_table_fingerprint"]
    events = spark.read.parquet(f"{data}/events.parquet")
    first = events.agg(F.min("event_id")).first()[0]
    late = F.col("ts") + F.expr("INTERVAL 1 MICROSECOND")
    changed = events.withColumn("ts", F.when(F.col("event_id") == first, late).otherwise(F.col("ts")))
    changed.write.parquet(f"{tmp_path}/events.parquet")
    was, now = run(spark, data).first(), run(spark, str(tmp_path)).first()
    assert was["row_count"] == now["row_count"] and was["xor_digest"] != now["xor_digest"]


def test_html_report_page_has_all_sections_in_order(spark, data):
    import __spark_entry__ as entry

    page = entry.queries()["html_report_page"](spark, data).orderBy("section", "item", "line_no").collect()
    assert {r["section"] for r in page} >= {0, 1, 2, 4}
    assert page[0]["line"].startswith("<!DOCTYPE html>") and page[-1]["line"] == "</table></body></html>"
