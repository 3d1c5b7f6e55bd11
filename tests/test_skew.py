"""Hot keys: the chunked plans give the same rows as one window per key."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from herdwatch.operators import clean, detect, order_stats, quality, skew

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def readings(spark):
    """One animal holds most rows, bunched in time; some values, dates and animals are missing."""
    rng = random.Random(7)
    out = []
    for i in range(600):
        tag = 1 if i % 3 else rng.choice([2, 3, 4, None])
        minute = rng.randrange(2000) if rng.random() < 0.6 else rng.randrange(40)
        date = None if rng.random() < 0.02 else START + timedelta(minutes=minute)
        values = [None if rng.random() < 0.4 else rng.uniform(30, 45) for _ in range(3)]
        out.append((i, tag, date, *values))
    return spark.createDataFrame(
        out, "arrival_id long, tag_id long, date timestamp_ntz, temperature double, heart_rate double, activity_level double"
    )


@pytest.mark.parametrize("limit", [5, 17, 60])
def test_chunks_are_small_and_in_order(readings, limit):
    chunked = skew.add_chunks(readings, ["tag_id"], ["date", "arrival_id"], limit)
    biggest = chunked.filter(F.size("_chunk") > 0).groupBy("tag_id", "_chunk").count().agg(F.max("count")).first()[0]
    assert biggest <= limit
    mine = chunked.filter("tag_id = 1").orderBy(F.col("date").asc_nulls_first(), "arrival_id").collect()
    numbers = [r["_chunk"] for r in mine]
    assert numbers == sorted(numbers)
    assert chunked.count() == readings.count()


def test_no_hot_key_means_plain_plan(readings):
    assert skew.add_chunks(readings, ["tag_id"], ["date"], 10_000) is None


@pytest.mark.parametrize("limit", [4, 9, 50])
def test_rolling_zscore(readings, limit):
    order = ("date", "arrival_id")
    plain = detect.rolling_zscore(readings, order_by=order)
    assert rows(detect.rolling_zscore(readings, order_by=order, hot_key_rows=limit)) == rows(plain)


def test_rolling_zscore_over_whole_table(readings):
    whole = detect.rolling_zscore(readings, partition_by=(), order_by=("arrival_id",))
    cut = detect.rolling_zscore(readings, partition_by=(), order_by=("arrival_id",), hot_key_rows=25)
    assert rows(cut) == rows(whole)


@pytest.mark.parametrize("limit", [3, 20])
def test_fill(readings, limit):
    assert rows(clean.fill_missing(readings, hot_key_rows=limit)) == rows(clean.fill_missing(readings))


def test_fill_long_gap(spark):
    """The carried value crosses many chunks without any known value."""
    gap = [(i, 1, 5.0 if i == 0 else (9.0 if i == 199 else None)) for i in range(200)]
    df = spark.createDataFrame(gap, "arrival_id long, tag_id long, temperature double")
    got = clean.fill_missing(df, ["temperature"], hot_key_rows=10).orderBy("arrival_id").collect()
    assert [r["temperature"] for r in got] == [5.0] * 199 + [9.0]
    tail = df.withColumn("temperature", F.when(F.col("arrival_id") > 150, F.col("arrival_id").cast("double")))
    got = clean.fill_missing(tail, ["temperature"], hot_key_rows=10).orderBy("arrival_id").collect()
    assert [r["temperature"] for r in got][:152] == [151.0] * 152


@pytest.mark.parametrize("limit", [None, 7, 40])
def test_quantiles(spark, limit):
    rng = np.random.default_rng(3)
    values = np.round(rng.normal(size=400), 2).tolist() + [0.5] * 200
    df = spark.createDataFrame([(i % 2, float(x)) for i, x in enumerate(values)], "k long, v double")
    got = order_stats.quantiles(df, "v", {"a": 0.25, "b": 0.5, "c": 0.9}, ["k"], limit)
    for r in got.collect():
        part = [x for i, x in enumerate(values) if i % 2 == r["k"]]
        assert np.allclose([r["a"], r["b"], r["c"]], np.quantile(part, [0.25, 0.5, 0.9]))
    whole = order_stats.quantiles(df, "v", {"m": 0.1}, max_rows=limit).first()
    assert np.isclose(whole["m"], np.quantile(values, 0.1))


@pytest.mark.parametrize("limit", [None, 5])
def test_nearest_rank(spark, limit):
    values = [5.0, 1.0, 1.0, 9.0, 7.0, 3.0, 3.0, 2.0, 8.0, 4.0, 6.0] * 3
    df = spark.createDataFrame([("op", x) for x in values], "k string, v double")
    got = order_stats.nearest_rank(df, "v", 0.95, ["k"], "p", limit).first()["p"]
    assert got == sorted(values)[int(len(values) * 0.95)]


@pytest.mark.parametrize("limit", [None, 6])
def test_number_rows(spark, limit):
    names = [f"FARM-{i % 13:04d}-{i}" for i in range(60)]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r["name"]: r["i"] for r in order_stats.number_rows(df, ["name"], "i", max_rows=limit).collect()}
    assert got == {n: i for i, n in enumerate(sorted(names))}


@pytest.mark.parametrize("limit", [4, 30])
def test_date_disorder_and_gaps(readings, limit):
    assert rows(quality.date_disorder(readings, hot_key_rows=limit)) == rows(quality.date_disorder(readings))
    assert rows(quality.update_gaps(readings, limit)) == rows(quality.update_gaps(readings))


def test_chunks_of_uneven_values_end_below_the_limit(spark):
    """Geometric values, long common prefixes, many ties with a few others, NaN and nulls."""
    tables = {
        "geometric": ([(1.5**i,) for i in range(200)], "double"),
        "prefix": ([("p" * 60 + f"{i:04d}",) for i in range(200)], "string"),
        "ties": ([(5.0 if i % 10 else float(i),) for i in range(200)], "double"),
        "missing": ([(None if i % 4 == 0 else float("nan") if i % 4 == 1 else float(i),) for i in range(200)], "double"),
    }
    for name, (values, kind) in tables.items():
        df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], f"id long, v {kind}")
        chunked = skew.add_chunks(df, (), ["v", "id"], 10)
        assert max(r["count"] for r in chunked.groupBy("_chunk").count().collect()) <= 10, name
        rows = chunked.collect()

        def sortable(v):
            return (0, 0) if v is None else (2, 0) if v != v else (1, v)

        by_chunk = [r["id"] for r in sorted(rows, key=lambda r: (list(r["_chunk"]), sortable(r["v"]), r["id"]))]
        assert by_chunk == [r["id"] for r in sorted(rows, key=lambda r: (sortable(r["v"]), r["id"]))], name


def test_whole_numbers_beyond_exact_doubles_are_cut(spark):
    big = 2**60
    df = spark.createDataFrame([(1, s * (big + i)) for i in range(40) for s in (1, -1)], "k int, n bigint")
    chunked = skew.add_chunks(df, ["k"], ["n"], 8)
    assert chunked.groupBy("k", "_chunk").count().agg(F.max("count")).first()[0] <= 8
    numbers = [r["_chunk"] for r in chunked.orderBy("n").collect()]
    assert numbers == sorted(numbers)


def test_texts_that_differ_late_are_cut(spark):
    """The first 600 bytes are the same; only a few numbers are looked at in one level."""
    df = spark.createDataFrame([(1, "x" * 600 + f"{i:03d}") for i in range(60)], "k int, t string")
    chunked = skew.add_chunks(df, ["k"], ["t"], 10)
    assert chunked.groupBy("k", "_chunk").count().agg(F.max("count")).first()[0] <= 10
    texts = [r["_chunk"] for r in chunked.orderBy("t").collect()]
    assert texts == sorted(texts)
    same = spark.createDataFrame([(1, "same")] * 30, "k int, t string")
    assert skew.add_chunks(same, ["k"], ["t"], 10) is None


@pytest.mark.parametrize("limit", [5, 60])
def test_chunks_are_found_without_a_lambda_over_the_cuts(readings, limit):
    """A lambda is interpreted for each cut and row; places that equal a cut are chunks of their own as before."""
    chunked = skew.add_chunks(readings.where("tag_id = 1"), [], ["heart_rate", "arrival_id"], limit)
    plan = chunked._jdf.queryExecution().analyzed().toString()
    assert "lambdafunction" not in plan
    mine = chunked.orderBy(F.col("heart_rate").asc_nulls_first(), "arrival_id").collect()
    assert [r["_chunk"] for r in mine] == sorted(r["_chunk"] for r in mine)


def test_cuts_up_to_a_place(spark):
    cuts = [[], [1.0], [1.0, 2.0, 5.0], [float(x) for x in range(63)]]
    places = [None, -1.0, 0.0, 1.0, 1.5, 5.0, 61.5, 62.0, 63.0, float("inf"), float("-inf")]
    shape = "_cuts array<double>, _place double"
    got = skew._cuts_up_to(spark.createDataFrame([(c, p) for c in cuts for p in places], shape)).collect()
    assert all(r["_upto"] == sum(c <= r["_place"] for c in r["_cuts"]) for r in got if r["_place"] is not None)
    assert len(got) == len(cuts) * len(places)
