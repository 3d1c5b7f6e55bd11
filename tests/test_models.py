"""Isolation forest, ensemble, clusters, seasonal decomposition."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from herdwatch.constants import METRICS, DetectionSettings
from herdwatch.operators import clusters, ensemble, iforest, seasonal

START = datetime(2024, 1, 4)  # start of an epoch-aligned 7-day window


@pytest.fixture(scope="module")
def herd(spark):
    rng = np.random.default_rng(42)
    out = []
    for i in range(400):
        odd = i >= 380
        out.append((
            i, f"A{i % 40}", f"F{i % 4}", ["cattle", "sheep"][i % 2], START + timedelta(hours=i),
            float(41.5 + rng.random() if odd else rng.normal(38.5, 0.3)),
            float(100 + rng.random() * 10 if odd else rng.normal(70, 5)),
            None if i % 50 == 7 else float(0.2 if odd else rng.normal(1.0, 0.1)),
        ))
    return spark.createDataFrame(out, "arrival_id long, tag_id string, farm_id string, animal_type string, "
                                 "date timestamp_ntz, temperature double, heart_rate double, activity_level double")


@pytest.fixture(scope="module")
def forest(herd):
    return iforest.fit(herd, METRICS, ["arrival_id"])


def test_forest_properties(herd, forest):
    got = iforest.apply_to_training(herd, forest).collect()
    assert abs(np.mean([r["if_anomaly"] for r in got]) - 0.1) <= 0.01
    scores = np.array([r["if_anomaly_score"] for r in got])
    assert scores.min() == 0 and scores.max() == 10
    assert all(r["if_anomaly"] for r in got if r["arrival_id"] >= 380)
    for m in METRICS:
        share = np.array([r[f"{m}_if_contribution"] for r in got])
        assert share.min() >= 0 and share.max() == pytest.approx(1.0)
    assert len(set(forest.nodes["tree"])) == 100
    leaves = forest.nodes[forest.nodes["feature"] < 0]
    assert (leaves.groupby("tree")["size"].sum() == 256).all()
    assert forest.importance() == {m: 1 / 3 for m in METRICS}


def test_predict_on_training_table_equals_fit_results(herd, forest):
    assert rows(iforest.predict(herd, forest)) == rows(iforest.apply_to_training(herd, forest))


def test_forest_does_not_depend_on_row_order(herd, forest):
    shuffled = iforest.fit(herd.repartition(7).sort(F.rand(1)), METRICS, ["arrival_id"])
    assert shuffled.offset == pytest.approx(forest.offset)
    a, b = (f.nodes.sort_values(["tree", "node"]).reset_index(drop=True) for f in (shuffled, forest))
    assert a.drop(columns="split").equals(b.drop(columns="split"))
    assert np.allclose(a["split"], b["split"])  # means are added up in another order


def test_samples_of_a_large_table(herd):
    """Every tree has its size, no row twice; trees are drawn by hashes of their own, so that few rows are shared."""
    n, scaling = iforest._statistics(herd, METRICS)
    drawn = iforest._samples(herd, n, ["arrival_id"], METRICS, scaling, 10, 8, 42)
    per_tree = drawn.groupBy("tree").agg(F.count("*").alias("rows"), F.count_distinct("_h").alias("kinds")).collect()
    assert [(r["rows"], r["kinds"]) for r in per_tree] == [(8, 8)] * 10
    # 80 rows of n, tree by tree: about n (1 - (1 - 8/n)^10) distinct ones.
    expected = n * (1 - (1 - 8 / n) ** 10)
    assert abs(drawn.select("_h").distinct().count() - expected) <= 8
    got = iforest.detect(herd, METRICS, ["arrival_id"], trees=10, sample_size=8)
    assert got.filter("if_anomaly").count() <= 60


def test_path_length_by_hand():
    nodes = iforest._grow(np.array([[0.0], [1.0], [10.0]]), 8, np.random.default_rng(0))
    import pandas as pd
    table = pd.DataFrame(nodes, columns=["node", "feature", "split", "left", "right", "size", "depth"])
    table.insert(0, "tree", 0)
    got = iforest._mean_paths(iforest._tables(table), np.array([[0.0], [1.0], [10.0]]))
    assert sorted(got) == [1.0, 2.0, 2.0]
    assert iforest.mean_path(2) == 1 and iforest.mean_path(1) == 0
    assert iforest.mean_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_constant_feature_and_missing_features(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(20)], "arrival_id long, temperature double")
    got = iforest.detect(df, ["temperature", "absent"], ["arrival_id"], trees=5).collect()
    assert {r["if_anomaly_score"] for r in got} == {0.0} and not any(r["if_anomaly"] for r in got)
    with pytest.raises(ValueError):
        iforest.fit(df, ["absent"], ["arrival_id"])


def test_save_and_load(spark, herd, forest, tmp_path):
    iforest.save(spark, forest, str(tmp_path / "forest"))
    again = iforest.load(spark, str(tmp_path / "forest"))
    assert rows(iforest.apply_to_training(herd, again)) == rows(iforest.apply_to_training(herd, forest))
    assert rows(iforest.feature_importance(spark, again)) == [(m, round(1 / 3, 6)) for m in sorted(METRICS)]


def test_ensemble_and_clusters(herd, forest):
    settings = DetectionSettings(threshold=1.8, window_size=7)
    got = ensemble.detect_ensemble(herd, METRICS, settings=settings, forest=forest)
    for r in got.collect():
        flags = (r["stat_is_anomaly"], r["if_anomaly"], r["ensemble_anomaly"])
        names = [n for n, f in zip(("statistical", "isolation_forest", "ensemble"), flags) if f]
        assert r["is_anomaly"] == any(flags) and r["detection_method"] == ("+".join(names) or "none")
        want = max([float(f) for f in flags] + ([r["ensemble_anomaly_score"]] if r["ensemble_anomaly_score"] is not None else []))
        assert r["anomaly_score"] == pytest.approx(want)
    found = ensemble.detect_ensemble_clusters(got, min_cluster_size=3).collect()
    assert found and all(r["affected_animals"] >= 3 for r in found)
    both = [r for r in found if len(r["detection_methods"]) == 2]
    assert both and all(r["ensemble_score"] == pytest.approx(min(10, r["avg_anomaly_score"])) for r in both)


def test_severity_and_cluster_score(spark):
    cases = [(10, 0.0, "critical"), (1, 7.0, "critical"), (5, 1.0, "high"), (1, 5.0, "high"), (3, 0.0, "medium"),
             (1, 3.0, "medium"), (2, 2.9, "low"), (2, None, "low")]
    df = spark.createDataFrame([c[:2] for c in cases], "n int, s double")
    assert [r[0] for r in df.select(clusters.severity(F.col("n"), F.col("s"))).collect()] == [c[2] for c in cases]


def test_cluster_needs_enough_rows_not_animals(spark):
    df = spark.createDataFrame(
        [("F", "A", "cattle", START + timedelta(days=d), True, 2.0, True) for d in (0, 1, 6)]
        + [("F", "A", "cattle", START + timedelta(days=7), True, 2.0, True)]
        + [(None, "B", "sheep", START, True, 2.0, True)] * 3,
        "farm_id string, tag_id string, animal_type string, date timestamp_ntz, is_anomaly boolean, anomaly_score double, "
        "temperature_anomaly boolean")
    got = clusters.detect_clusters(df).collect()
    assert [(r["anomaly_rows"], r["affected_animals"], r["start_date"], r["metrics_affected"]) for r in got] == [
        (3, 1, START, ["temperature"])]
    assert clusters.detect_clusters(df, min_cluster_size=4).count() == 0


def test_detector_choice(herd):
    with pytest.raises(ValueError):
        ensemble.detect(herd, DetectionSettings("lstm"))
    with pytest.raises(ValueError):
        ensemble.detect(herd.select("arrival_id"))

    class Hot:
        def detect_anomalies(self, df, metrics):
            return df.withColumns({"is_anomaly": F.coalesce(F.col("temperature") > 41, F.lit(False)), "anomaly_score": F.lit(1.0)})

    assert isinstance(Hot(), ensemble.Detector)
    found = ensemble.detect(herd, custom=Hot())
    assert found.filter("is_anomaly").count() == 20
    days = ensemble.detect_outbreaks(found, custom=Hot())
    assert days.columns[0] == "farm_id" and days.first()["detection_method"] == "ensemble"
    stat = ensemble.detect(herd, DetectionSettings("statistical", threshold=1.5))
    assert ensemble.detect_outbreaks(stat, DetectionSettings("statistical")).count() > 0


def expected_parts(x, period, model):
    """Classical decomposition with trend ends on a line, written with plain numpy."""
    n, half = len(x), period // 2
    weights = np.ones(period) / period if period % 2 else np.r_[0.5, np.ones(period - 1), 0.5] / period
    trend = np.full(n, np.nan)
    for i in range(half, n - half):
        trend[i] = weights @ x[i - half : i + half + 1]
    first, last = half, n - 1 - half
    to, start = min(first + period, last), max(first, last - period)
    a, b = np.polyfit(np.arange(first, to), trend[first:to], 1)
    trend[:first] = a * np.arange(first) + b
    a, b = np.polyfit(np.arange(start, last), trend[start:last], 1)
    trend[last + 1 :] = a * np.arange(last + 1, n) + b
    free = x - trend if model == "additive" else x / trend
    means = np.array([free[i::period].mean() for i in range(period)])
    means = means - means.mean() if model == "additive" else means / means.mean()
    season = np.tile(means, n // period + 1)[:n]
    return trend, season, x - trend - season if model == "additive" else x / season / trend


@pytest.mark.parametrize(("period", "model"), [(7, "additive"), (7, "multiplicative"), (4, "additive")])
def test_decomposition(spark, period, model):
    rng = np.random.default_rng(5)
    n = 31
    x = 50 + 0.3 * np.arange(n) + 4 * np.sin(np.arange(n) * 2 * np.pi / period) + rng.normal(0, 1, n)
    gaps = {4, 5, 17}
    given = [(1, date(2024, 1, 1) + timedelta(days=i), float(v)) for i, v in enumerate(x) if i not in gaps]
    for g in sorted(gaps):
        x[g] = x[g - 1]
    df = spark.createDataFrame(given, "tag long, day date, v double")
    got = seasonal.decompose(df, "v", ["tag"], period=period, model=model).orderBy("day").collect()
    trend, season, rest = expected_parts(x, period, model)
    assert len(got) == n
    assert np.allclose([r["observed"] for r in got], x)
    assert np.allclose([r["trend"] for r in got], trend)
    assert np.allclose([r["seasonal"] for r in got], season)
    assert np.allclose([r["residual"] for r in got], rest)


def test_short_and_gappy_groups(spark):
    day = date(2024, 1, 1)
    short = [(1, day + timedelta(days=i), float(i)) for i in range(10)]
    nulls = [(2, day + timedelta(days=i), None if i < 3 else float(i)) for i in range(20)]
    df = spark.createDataFrame(short + nulls, "tag long, day date, v double")
    got = seasonal.adjust(df, "v", ["tag"]).collect()
    assert all(r["v_seasonal_adj"] == r["v"] for r in got if r["tag"] == 1)
    assert len(got) == 30 and all(r["v_seasonal_adj"] is not None for r in got if r["tag"] == 2)
    whole = seasonal.decompose(df.filter("tag = 2").drop("tag"), "v").orderBy("day").collect()
    assert whole[0]["observed"] == 3.0


def test_constant_series_has_no_anomaly(spark):
    df = spark.createDataFrame([(date(2024, 1, 1) + timedelta(days=i), 5.0) for i in range(21)], "day date, v double")
    assert {r["v_seasonal_anomaly"] for r in seasonal.detect_seasonal(df, "v").collect()} == {False}


def test_spike_is_a_seasonal_anomaly(spark):
    values = [10 + (i % 7) + (30 if i == 17 else 0) for i in range(42)]
    df = spark.createDataFrame([(date(2024, 1, 1) + timedelta(days=i), float(x)) for i, x in enumerate(values)], "day date, v double")
    hits = seasonal.detect_seasonal(df, "v", 3.0).filter("v_seasonal_anomaly").collect()
    assert [r["day"] for r in hits] == [date(2024, 1, 18)]
