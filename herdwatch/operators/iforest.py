"""Isolation forest: trees grown in parallel from hashed samples, scoring on the executors.

What reaches the driver is bounded by the parameters, not by the data: one row of column
statistics and at most ``trees * (2 * sample - 1)`` tree nodes.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import write_and_read
from .clusters import detect_clusters
from .order_stats import quantiles

NODES = "tree int, node int, feature int, split double, left int, right int, size int, depth int"
EULER = 0.5772156649015329


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n values."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    safe = np.where(big, n, 3.0)
    return np.where(big, 2 * (np.log(safe - 1) + EULER) - 2 * (safe - 1) / safe, out)


@dataclass(frozen=True)
class Forest:
    """A fitted forest. ``scaling`` holds mean, deviation and largest deviation per feature."""

    features: tuple[str, ...]
    scaling: dict
    sample_size: int
    contamination: float
    seed: int
    nodes: pd.DataFrame
    offset: float = -0.5
    lowest: float | None = None
    highest: float | None = None

    def importance(self) -> dict[str, float]:
        """Equal shares: the forest keeps no importance of its own."""
        return {f: 1.0 / len(self.features) for f in self.features}


def _statistics(df: DataFrame, features: Sequence[str]) -> tuple[int, dict]:
    """Row count and, per feature, mean, deviation and reach after replacing nulls by the mean."""
    row = df.agg(
        F.count("*").alias("n"),
        *[
            F.struct(
                F.count(f).alias("k"), F.avg(f).alias("mean"), F.var_pop(f).alias("var"),
                F.min(f).alias("lo"), F.max(f).alias("hi"),
            ).alias(f)
            for f in features
        ],
    ).first()
    scaling = {}
    for f in features:
        s = row[f]
        if s["k"] == 0:
            raise ValueError(f"feature {f} has no values")
        spread = math.sqrt(s["var"] * s["k"] / row["n"]) or 1.0
        reach = max(s["hi"] - s["mean"], s["mean"] - s["lo"]) / spread
        scaling[f] = {"mean": float(s["mean"]), "scale": float(spread), "reach": float(reach)}
    return int(row["n"]), scaling


def _scaled(feature: str, scaling: dict) -> Column:
    s = scaling[feature]
    return (F.coalesce(F.col(feature).cast("double"), F.lit(s["mean"])) - s["mean"]) / s["scale"]


def _samples(
    df: DataFrame, rows: int, ids: Sequence[str], features: Sequence[str], scaling: dict, trees: int, size: int,
    seed: int,
) -> DataFrame:
    """``size`` rows for each tree, chosen by hashes of the row id; one scheme for every size of table.

    A row's hash is a point u of the unit circle, tree t draws from the points between t / trees and
    that plus ``share``. The share is set so that every tree sees about twice the rows it needs (all
    rows of a small table), and keeps those that are first by a hash of their own.
    """
    base = df.select(
        F.xxhash64(*ids, F.lit(seed)).alias("_h"), *[_scaled(f, scaling).alias(f) for f in features]
    )
    share = min(1.0, (2 * size + 50) / max(rows, 1))
    u = F.pmod("_h", F.lit(1 << 40)) / float(1 << 40)
    last, first = F.floor(u * trees), F.floor((u - share) * trees) + 1
    near = base.withColumns({"_last": last.cast("int"), "_first": first.cast("int")}).filter("_first <= _last")
    each = near.withColumn("_place", F.explode(F.sequence("_first", "_last")))
    each = each.withColumn("tree", F.pmod("_place", F.lit(trees)).cast("int"))
    draw = W.partitionBy("tree").orderBy("_d", "_h", *features)
    return (
        each.drop("_first", "_last", "_place").withColumn("_d", F.xxhash64("_h", "tree"))
        .withColumn("_rank", F.row_number().over(draw))
        .filter(F.col("_rank") <= size)
    )


def _grow(values: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes (node, feature, split, left, right, size, depth) of one random tree; right = left + 1."""
    nodes: list[tuple] = [()]
    todo = [(0, np.arange(len(values)), 0)]
    while todo:
        number, rows, depth = todo.pop()
        part = values[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= limit or len(varying) == 0:
            nodes[number] = (number, -1, 0.0, -1, -1, len(rows), depth)
            continue
        feature = int(rng.choice(varying))
        split = float(rng.uniform(low[feature], high[feature]))
        goes_left = part[:, feature] <= split
        left = len(nodes)
        nodes[number] = (number, feature, split, left, left + 1, len(rows), depth)
        nodes += [(), ()]
        todo += [(left + 1, rows[~goes_left], depth + 1), (left, rows[goes_left], depth + 1)]
    return nodes


def _tables(nodes: pd.DataFrame) -> dict[str, np.ndarray]:
    """All trees in flat arrays; tree t starts at ``roots[t]``.

    A leaf points to itself behind a split that nothing exceeds, and holds its path length.
    """
    trees, width = int(nodes["tree"].max()) + 1, int(nodes["node"].max()) + 1
    at = nodes["tree"].to_numpy() * width + nodes["node"].to_numpy()
    leaf = nodes["feature"].to_numpy() < 0
    out = {}
    for name, values, kind in (
        ("feature", np.where(leaf, 0, nodes["feature"]), np.int64),
        ("split", np.where(leaf, np.inf, nodes["split"]), float),
        ("left", np.where(leaf, at, nodes["tree"] * width + nodes["left"]), np.int64),
        ("path", np.where(leaf, nodes["depth"] + mean_path(nodes["size"].to_numpy()), 0.0), float),
    ):
        out[name] = np.zeros(trees * width, dtype=kind)
        out[name][at] = values
    out["roots"] = np.arange(trees, dtype=np.int64) * width
    out["depth"] = np.array(int(nodes["depth"].max()))
    return out


def _mean_paths(tables: dict[str, np.ndarray], values: np.ndarray, block: int = 256) -> np.ndarray:
    """Mean path length over the trees, per row; blocks of rows keep the work in the CPU cache."""
    out = np.empty(len(values))
    for start in range(0, len(values), block):
        rows = np.ascontiguousarray(values[start : start + block])
        flat, first = rows.ravel(), (np.arange(len(rows)) * rows.shape[1])[:, None]
        at = np.broadcast_to(tables["roots"], (len(rows), len(tables["roots"])))
        for _ in range(int(tables["depth"])):
            value = flat.take(tables["feature"].take(at) + first)
            at = tables["left"].take(at) + (value > tables["split"].take(at))
        out[start : start + block] = tables["path"].take(at).mean(axis=1)
    return out


def score_column(spark: SparkSession, forest: Forest) -> Column:
    """Score per row: -2^(-mean path / expected path); lower is more unusual.

    Only the features travel to Python, in Arrow batches.
    """
    shared = spark.sparkContext.broadcast(_tables(forest.nodes))
    expected = float(mean_path(forest.sample_size)) or 1.0

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        tables = shared.value
        for batch in batches:
            paths = _mean_paths(tables, batch.to_numpy(dtype=float))
            yield pd.Series(-np.power(2.0, -paths / expected))

    # Marked so that a filter on the score is not pushed below it, which would score rows twice.
    once = score.asNondeterministic()
    return once(F.struct(*[_scaled(f, forest.scaling).alias(f) for f in forest.features]))


def grow(
    df: DataFrame, features: Sequence[str], ids: Sequence[str], *, trees: int = 100, sample_size: int = 256,
    contamination: float = 0.1, seed: int = 42,
) -> Forest:
    """The trees, without a threshold.

    ``ids`` identify a row and stay the same on every read. Nulls count as the column mean.
    """
    features = tuple(f for f in features if f in df.columns)
    if not features:
        raise ValueError("no valid feature columns found")
    rows, scaling = _statistics(df, features)
    size = min(sample_size, rows)
    limit = max(1, math.ceil(math.log2(max(size, 2))))
    names = list(features)

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_rank"])
        tree = int(part["tree"].iloc[0])
        grown = _grow(part[names].to_numpy(dtype=float), limit, np.random.default_rng([seed, tree]))
        out = pd.DataFrame(grown, columns=["node", "feature", "split", "left", "right", "size", "depth"])
        out.insert(0, "tree", tree)
        return out

    drawn = _samples(df, rows, ids, features, scaling, trees, size, seed).select("tree", "_rank", *names)
    # A fixed number of partitions: the samples are small, and would otherwise be merged into one task.
    spread = drawn.repartition(min(trees, df.sparkSession.sparkContext.defaultParallelism), "tree")
    nodes = spread.groupBy("tree").applyInPandas(build, NODES).toPandas()
    return Forest(features, scaling, size, contamination, seed, nodes)


def fit(df: DataFrame, features: Sequence[str], ids: Sequence[str], *, max_rows: int | None = None, **options) -> Forest:
    """Grow the forest and set its threshold to the contamination quantile of the training scores."""
    return score_once(df, grow(df, features, ids, **options), only_score=True, max_rows=max_rows)[0]


def score_once(
    df: DataFrame, grown: Forest, *, only_score: bool = False, max_rows: int | None = None, observed: Sequence[Column] = (),
) -> tuple[Forest, DataFrame, dict]:
    """(forest with threshold and extremes, stored rows with ``_score``, values of ``observed`` aggregates).

    Rows are scored while they are stored; extremes and other totals are observed in the same pass, and the
    threshold is read from the stored scores.
    """
    scored = df.select(*([] if only_score else df.columns), score_column(df.sparkSession, grown).alias("_score"))
    seen = Observation()
    ends = [F.min("_score").alias("_lowest"), F.max("_score").alias("_highest")]
    # On top of the write: a task that is repeated counts once.
    kept = write_and_read(scored.observe(seen, *ends, *observed), "scores")
    offset = quantiles(kept, "_score", {"offset": grown.contamination}, max_rows=max_rows).first()["offset"]
    found = seen.get
    return replace(grown, offset=offset, lowest=found["_lowest"], highest=found["_highest"]), kept, found


def _add_results(df: DataFrame, forest: Forest, low: Column, high: Column, reach: dict[str, Column]) -> DataFrame:
    scored = df if "_score" in df.columns else df.withColumn("_score", score_column(df.sparkSession, forest))
    s = F.col("_score")
    scored = scored.withColumns(
        {
            "if_anomaly": s < F.lit(forest.offset),
            "if_anomaly_score": F.when(high > low, 10 * (1 - (s - low) / (high - low))).otherwise(0.0),
            **{
                f"{f}_if_contribution": F.when(
                    reach[f] > 0, F.abs(_scaled(f, forest.scaling)) / reach[f]
                ).otherwise(0.0)
                for f in forest.features
            },
        }
    )
    return scored.drop("_score")


def predict(df: DataFrame, forest: Forest) -> DataFrame:
    """Flag, score from 0 to 10 and contribution per feature for any table."""
    seen = df.withColumn("_score", score_column(df.sparkSession, forest)).agg(
        F.struct(
            F.min("_score").alias("lo"), F.max("_score").alias("hi"),
            *[F.max(F.abs(_scaled(f, forest.scaling))).alias(f"reach_{f}") for f in forest.features],
        ).alias("s")
    ).scalar()
    return _add_results(df, forest, seen["lo"], seen["hi"], {f: seen[f"reach_{f}"] for f in forest.features})


def detect(df: DataFrame, features: Sequence[str], ids: Sequence[str], **options) -> DataFrame:
    """Fit and predict on the same table, whose rows are scored once and stored."""
    max_rows = options.pop("max_rows", None)
    forest, kept, _ = score_once(df, grow(df, features, ids, **options), max_rows=max_rows)
    return apply_to_training(kept, forest)


def apply_to_training(df: DataFrame, forest: Forest) -> DataFrame:
    """Results for the table the forest was fitted on; scores it has as ``_score`` are taken."""
    reach = {f: F.lit(forest.scaling[f]["reach"]) for f in forest.features}
    return _add_results(df, forest, F.lit(forest.lowest), F.lit(forest.highest), reach)


def top_features(features: Sequence[str], columns: Sequence[str], k: int = 3) -> Column:
    """Aggregate: the k features with the highest mean contribution, highest first."""
    ranked = [
        F.struct((-F.avg(f"{f}_if_contribution")).alias("weight"), F.lit(i).alias("i"), F.lit(f).alias("feature"))
        for i, f in enumerate(features)
        if f"{f}_if_contribution" in columns
    ]
    if not ranked:
        return F.expr("CAST(array() AS ARRAY<STRING>)")
    return F.transform(F.slice(F.array_sort(F.array(*ranked)), 1, k), lambda s: s["feature"])


def detect_forest_clusters(
    df: DataFrame, features: Sequence[str], *, window: str = "7 days", min_cluster_size: int = 3
) -> DataFrame:
    """Clusters of rows the forest flagged, with their leading features."""
    if "if_anomaly" not in df.columns:
        raise ValueError("the table has no column if_anomaly")
    found = detect_clusters(
        df, window=window, min_cluster_size=min_cluster_size, flag="if_anomaly", score="if_anomaly_score",
        metrics=(), extra=[top_features(features, df.columns).alias("features_contributing")],
    )
    return found.drop("metrics_affected").withColumn("detection_method", F.lit("isolation_forest"))


def feature_importance(spark: SparkSession, forest: Forest) -> DataFrame:
    shares = F.create_map(*[F.lit(x) for pair in forest.importance().items() for x in pair])
    return spark.range(1).select(F.explode(shares).alias("feature", "importance"))


def save(spark: SparkSession, forest: Forest, path: str) -> None:
    """The nodes as a Parquet table and the parameters as one JSON line."""
    spark.createDataFrame(forest.nodes, NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    parameters = {k: v for k, v in asdict(replace(forest, nodes=None)).items() if k != "nodes"}
    spark.range(1).select(F.lit(json.dumps(parameters)).alias("value")).write.mode("overwrite").text(
        f"{path}/parameters"
    )


def load(spark: SparkSession, path: str) -> Forest:
    nodes = spark.read.parquet(f"{path}/nodes").toPandas()
    raw = json.loads(spark.read.text(f"{path}/parameters").first()["value"])
    raw["features"] = tuple(raw["features"])
    return Forest(nodes=nodes, **raw)
