from datetime import datetime, timedelta

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from herdwatch.functions import scalars as s
from herdwatch.operators import clean, detect, normalize, stats

START = datetime(2024, 1, 1)
SHAPE = "arrival_id long, tag_id string, date timestamp_ntz, animal_type string, temperature double, heart_rate double, activity_level double"


def sample(spark, temperatures, **over):
    base = {"tag": "A1", "kind": "cattle"}
    base.update(over)
    out = [
        (i, base["tag"], START + timedelta(days=i), base["kind"], t, 70.0 + i, 0.05 if i == 0 else 1.0)
        for i, t in enumerate(temperatures)
    ]
    return spark.createDataFrame(out, SHAPE)


def test_clean_fills_types_flags_and_clips(spark):
    got = clean.clean(sample(spark, [38.5, None, 42.0, None])).orderBy("arrival_id").collect()
    assert [r["temperature"] for r in got] == [38.5, 38.5, 42.0, 42.0]
    assert [r["temperature_flag"] for r in got] == [None, None, "extreme", "extreme"]
    assert got[0]["activity_level"] == 0.1


def test_leading_gap_takes_first_known_and_all_null_takes_mean(spark):
    df = sample(spark, [None, 40.0]).unionByName(sample(spark, [None, None], tag="A2"))
    got = rows(clean.clean(df.withColumn("date", F.col("date") + F.expr("INTERVAL 0 DAYS"))).select("tag_id", "temperature"))
    assert got == [("A1", 40.0), ("A1", 40.0), ("A2", 40.0), ("A2", 40.0)]


def test_fill_follows_arrival_not_date(spark):
    df = spark.createDataFrame(
        [(0, "A", START + timedelta(days=2), 1.0), (1, "A", START, None), (2, "A", START + timedelta(days=1), 3.0)],
        "arrival_id long, tag_id string, date timestamp_ntz, temperature double",
    )
    assert rows(clean.fill_missing(df).select("arrival_id", "temperature")) == [(0, 1.0), (1, 1.0), (2, 3.0)]


def test_first_arrival_of_a_duplicate_stays(spark):
    df = spark.createDataFrame([(5, "A", 1, "x"), (3, "A", 1, "y"), (9, "B", 1, "z")], "arrival_id long, tag_id string, date long, v string")
    assert rows(clean.remove_duplicates(df).select("v")) == [("y",), ("z",)]


def test_dedup_limits_rows_before_the_shuffle(spark, data):
    df = spark.read.parquet(f"{data}/events.parquet").selectExpr("event_id AS arrival_id", "user_id AS tag_id", "ts AS date")
    plan = clean.remove_duplicates(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_unknown_type_has_range_zero_to_one(spark):
    df = sample(spark, [38.5], kind="llama").unionByName(sample(spark, [38.5], kind=None))
    assert rows(clean.flag_ranges(df).select("animal_type", "temperature_flag")) == [("llama", "extreme"), (None, None)]


def test_types_are_coerced(spark):
    df = spark.createDataFrame([("1.5", "2024-01-02"), ("x", "nope"), (None, None)], "temperature string, date string")
    assert rows(clean.fix_types(df)) == [(1.5, datetime(2024, 1, 2)), (None, None), (None, None)]


def test_iqr(spark):
    df = spark.createDataFrame([(float(x),) for x in [*range(20), 100, -80]], "v double")
    assert rows(clean.iqr_outliers(df, "v")) == [(-80.0,), (100.0,)]
    assert clean.iqr_outliers(df, "other") is df


def test_zscore_of_constant_and_single_values_is_null(spark):
    df = sample(spark, [38.0] * 5).unionByName(sample(spark, [39.0], tag="B"))
    assert {r["temperature_zscore"] for r in detect.rolling_zscore(df, ["temperature"]).collect()} == {None}


def test_zscore_values_and_threshold(spark):
    values = [38.1, 38.4, None, 38.2, 40.9, 38.3, 38.5, 38.6, 41.2, 38.0]
    got = detect.detect_statistical(sample(spark, values), ["temperature", "absent"], threshold=1.5).orderBy("date").collect()
    for i, row in enumerate(got):
        frame = [x for x in values[max(0, i - 6): i + 1] if x is not None]
        if values[i] is None or len(frame) < 2:
            assert row["temperature_zscore"] is None and not row["temperature_anomaly"]
            continue
        z = (values[i] - np.mean(frame)) / np.std(frame, ddof=1)
        assert np.isclose(row["temperature_zscore"], z)
        assert row["is_anomaly"] == (abs(z) > 1.5) and np.isclose(row["anomaly_score"], abs(z))


def test_score_equal_to_the_threshold_is_not_above_it(spark):
    for a, b in ((0.1, 0.7), (38.37, 40.11), (1 / 3, 2.9)):
        got = detect.detect_statistical(sample(spark, [a, a, a, b]), ["temperature"], threshold=1.5).collect()
        assert not any(r["is_anomaly"] for r in got) and max(r["anomaly_score"] or 0 for r in got) > 1.4999


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, None), (5.0, 5.0)], "a double, b double")
    for method, want in (("standard", [-1.224745, 0.0, 1.224745]), ("minmax", [0.0, 0.5, 1.0])):
        fitted = normalize.fit(df, ["a", "b", "absent"], method)
        scaled = normalize.transform(df, fitted, ["a", "b"])
        got = [r["a_normalized"] for r in scaled.collect()]
        assert got[2] is None and np.allclose([got[0], got[1], got[3]], want)
        assert {r["b_normalized"] for r in scaled.collect()} == {0.0, None}
        back = normalize.inverse_transform(scaled, fitted, ["a"])
        assert [r["a_original"] and round(r["a_original"], 9) for r in back.collect()] == [1.0, 3.0, None, 5.0]


def test_scaler_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.0,), (4.0,)], "a double")
    normalize.save(normalize.fit(df, ["a"]), str(tmp_path / "scaler"))
    got = normalize.transform(df, normalize.load(spark, str(tmp_path / "scaler")), ["a"])
    assert rows(got.select("a_normalized")) == [(-1.0,), (1.0,)]


def test_health_score(spark):
    df = spark.createDataFrame(
        [("cattle", 38.5, 60.0, 1.0), ("cattle", 40.0, 90.0, 0.5), ("goat", 39.0, 60.0, 1.0), (None, None, None, None)],
        "animal_type string, temperature double, heart_rate double, activity_level double",
    )
    got = [r[0] for r in df.select(s.health_score()).collect()]
    # goat has no heart-rate range: distance to [0, 1] is 59, so the score is clamped
    assert got == [100.0, 100 - 5 - 12 - 5, 0.0, 100.0]


def test_small_functions(spark):
    one = spark.range(1)
    assert one.select(s.animal_id(F.lit("F"), F.lit(7))).first()[0] == "F_0007"
    assert one.select(s.animal_id(F.lit("F"), F.lit(123456))).first()[0] == "F_123456"
    assert [one.select(s.size_text(F.lit(n))).first()[0] for n in (0, 10, 2048, 3 * 1024**3)] == ["0 B", "10.0 B", "2.0 KB", "3.0 GB"]
    dates = {"2024-05-06": True, "2024-05-06 07:08:09": True, "06/05/2024": True, "12/31/2024": True, "2024.05.06": False}
    assert {d: one.select(s.parse_date(F.lit(d)).isNotNull()).first()[0] for d in dates} == dates
    check = lambda a, b: one.select(s.valid_date_range(F.lit(a), F.lit(b), "2024-01-01 00:00:00")).first()[0]
    assert check("2023-01-01", "2023-02-01") and not check("2023-02-01", "2023-01-01")
    assert not check("1999-12-31", "2023-01-01") and not check("2023-01-01", "2025-06-01") and not check("x", "2023-01-01")


def test_drift_and_fingerprint(spark):
    ref = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "a double")
    cur = spark.createDataFrame([(4.0,), (5.0,), (6.0,)], "a double")
    assert rows(stats.data_drift(ref, cur, ["a", "absent"])) == [("a", 3.0)]
    assert rows(stats.fingerprint(ref)) == rows(stats.fingerprint(ref.orderBy(F.desc("a")).repartition(3)))
    assert rows(stats.fingerprint(ref)) != rows(stats.fingerprint(cur))
