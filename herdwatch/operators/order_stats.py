"""Exact ranks, medians and quantiles without sorting a whole key in one task.

For a large key only the chunk (see ``skew``) that holds a wanted rank is looked into: the
chunk sizes come from a map-side combined count, and the rows of all other chunks are never
shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .skew import CHUNK, add_chunks, running_total

Rank = Callable[[Column], Column]


def _within(rank: Column, start: Column, end: Column) -> Column:
    return (start <= rank) & (rank < end)


def _ranked(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct values per key with their first and last rank and the count ``_n`` of the key.

    Equal values are counted before anything is sorted.
    """
    counted = rows.groupBy(*keys, "_value").agg(F.count("*").alias("_c"))
    key = W.partitionBy(*keys)
    upto = F.sum("_c").over(key.orderBy("_value").rowsBetween(W.unboundedPreceding, 0))
    return counted.select(
        *keys, "_value", (upto - F.col("_c")).alias("_from"), upto.alias("_upto"),
        F.sum("_c").over(key).alias("_n"),
    )


def _ranked_where_wanted(chunked: DataFrame, keys: Sequence[str], ranks: Sequence[Rank]) -> DataFrame:
    """Like ``_ranked`` for the hot keys, limited to the chunks that hold a wanted rank."""
    hot = chunked.filter(F.size(CHUNK) > 0)
    along = W.partitionBy(*keys).orderBy(CHUNK)
    # One row per chunk of a hot key.
    sizes = hot.groupBy(*keys, CHUNK).agg(F.count("*").alias("_c"))
    placed = sizes.select(
        *keys, CHUNK,
        F.sum("_c").over(along.rowsBetween(W.unboundedPreceding, 0)).alias("_end"),
        (F.sum("_c").over(along.rowsBetween(W.unboundedPreceding, 0)) - F.col("_c")).alias("_start"),
        F.sum("_c").over(W.partitionBy(*keys)).alias("_n"),
    )
    hit = F.lit(False)
    for rank in ranks:
        hit = hit | _within(rank(F.col("_n")), F.col("_start"), F.col("_end"))
    names = [*keys, CHUNK]
    wanted = placed.filter(hit).select(*[F.col(c).alias(f"_w_{c}") for c in names], "_start", "_n")
    same = F.lit(True)
    for c in names:
        same = same & hot[c].eqNullSafe(wanted[f"_w_{c}"])
    # Bound: wanted ranks times hot keys, of which there are at most rows / max_rows.
    picked = hot.join(F.broadcast(wanted), same)
    counted = picked.groupBy(*keys, CHUNK, "_start", "_n", "_value").agg(F.count("*").alias("_c"))
    inside = W.partitionBy(*keys, CHUNK).orderBy("_value").rowsBetween(W.unboundedPreceding, 0)
    upto = F.col("_start") + F.sum("_c").over(inside)
    return counted.select(*keys, "_value", (upto - F.col("_c")).alias("_from"), upto.alias("_upto"), "_n")


def at_ranks(
    df: DataFrame, value: str, ranks: dict[str, Rank], keys: Sequence[str] = (), max_rows: int | None = None
) -> DataFrame:
    """Per key the number ``_n`` of known values and the values at the given ranks (from 0).

    A rank is a function of the ``_n`` column.
    """
    rows = df.select(*keys, F.col(value).alias("_value")).filter(F.col("_value").isNotNull())
    chunked = add_chunks(rows, keys, ["_value"], max_rows)
    if chunked is None:
        ranked = _ranked(rows, keys)
    else:
        cold = _ranked(chunked.filter(F.size(CHUNK) == 0).drop(CHUNK), keys)
        ranked = cold.unionByName(_ranked_where_wanted(chunked, keys, list(ranks.values())))
    n = F.col("_n")
    return ranked.groupBy(*keys).agg(
        F.max(n).alias("_n"),
        *[
            F.max(F.when(_within(rank(n), F.col("_from"), F.col("_upto")), F.col("_value"))).alias(name)
            for name, rank in ranks.items()
        ],
    )


def quantiles(
    df: DataFrame, value: str, probabilities: dict[str, float], keys: Sequence[str] = (),
    max_rows: int | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per key (one row without keys)."""

    def place(p: float) -> Rank:
        return lambda n: (n - 1) * F.lit(float(p))

    def below(p: float) -> Rank:
        return lambda n: F.floor(place(p)(n))

    def above(p: float) -> Rank:
        return lambda n: F.ceil(place(p)(n))

    ranks = {f"_lo_{name}": below(p) for name, p in probabilities.items()}
    ranks.update({f"_hi_{name}": above(p) for name, p in probabilities.items()})
    found = at_ranks(df, value, ranks, keys, max_rows)
    n = F.col("_n")
    out = []
    for name, p in probabilities.items():
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * (place(p)(n) - below(p)(n))).alias(name))
    return found.select(*keys, *out)


def nearest_rank(
    df: DataFrame, value: str, share: float, keys: Sequence[str], into: str, max_rows: int | None = None
) -> DataFrame:
    """The value at rank floor(share * n), from 0, per key."""
    found = at_ranks(df, value, {into: lambda n: F.floor(n * F.lit(share))}, keys, max_rows)
    return found.select(*keys, into)


def number_rows(
    df: DataFrame, order: Sequence[str], into: str, keys: Sequence[str] = (), max_rows: int | None = None
) -> DataFrame:
    """Number rows from 0 in the given order, which must be unique."""
    counted = df.withColumn("_one", F.lit(1).cast("long"))
    numbered = running_total(counted, keys, order, "_one", "_upto", max_rows)
    return numbered.withColumn(into, F.col("_upto") - 1).drop("_one", "_upto")
