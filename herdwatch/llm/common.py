"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# What separates words.
BLANKS = r"[\x20\x09-\x0D]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# A list of ids up to this many rows (8 bytes each) is broadcast; a longer one is shuffled.
BROADCAST_IDS = 1_000_000


def give_back() -> None:
    """Returns memory that a task has freed to the system: Python workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        # Another C library: it keeps what it likes.
        pass


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; plain ASCII texts take the faster built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column, separators: str) -> Column:
    """The words of a text in order; null has none. Keep this in a column of its own before use in lambdas."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), separators), "")


def with_shingles(df: DataFrame, text: str, separators: str, size: int, out: str, count: str) -> DataFrame:
    """Adds 64-bit hashes of all runs of ``size`` words (in ``out``) and the number of words (in ``count``).

    A text of fewer words is one shingle, a text without words has none.
    """
    df = df.withColumn("_w", words(F.col(text), separators)).withColumn(count, F.size("_w").cast("long"))
    runs = F.transform(F.sequence(F.lit(1), F.size("_w") - (size - 1)), lambda i: F.xxhash64(F.slice("_w", i, size)))
    return df.withColumn(
        out,
        F.when(F.size("_w") >= size, runs)
        .when(F.size("_w") > 0, F.array(F.xxhash64("_w")))
        .otherwise(F.array().cast("array<bigint>")),
    ).drop("_w")


def only_ids(df: DataFrame, ids: DataFrame, key: str, bound: int = BROADCAST_IDS) -> DataFrame:
    """Rows of ``df`` whose key is in ``ids`` (a stored table with the one column ``key``).

    A counted list of at most ``bound`` ids is broadcast, so that the rows need no shuffle; beyond it both
    sides are shuffled.
    """
    return df.join(small(ids, bound), key, "left_semi")


def small(df: DataFrame, bound: int) -> DataFrame:
    """A stored table, marked for broadcast if it has at most ``bound`` rows."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def in_blocks(rows: DataFrame, keys: list[str], spread: str, size: int) -> DataFrame:
    """Cuts each key's rows into blocks of about ``size`` rows, and repeats a row for each pair of blocks it is in.

    Adds ``blk`` (the row's block) and ``lo``, ``hi`` (a pair of blocks, lo <= hi): all pairs of rows of a key meet
    in exactly one (key, lo, hi), or, for rows of the same block, in the one with lo = hi = blk. A key of up to
    ``size`` rows is one block.
    """
    total = rows.groupBy(*keys).agg(F.count("*").alias("_total"))
    out = rows.join(total, keys).withColumn("_n", F.ceil(F.col("_total") / size).cast("int"))
    out = out.withColumn("blk", F.pmod(F.xxhash64(spread), F.col("_n")).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return out.withColumn("lo", F.least("blk", "_other")).withColumn("hi", F.greatest("blk", "_other")).drop("_total", "_n", "_other")


def components(pairs: DataFrame) -> DataFrame:
    """Connected components of the links (a, b): rows (id, root), root the least id, for ids with a link.

    Each round every id takes its least neighbour, paths are cut short twice, and the links are carried over
    to the new labels; labels and links are stored in the shared folder, so that a round depends on the
    last one only. Links shrink from round to round, none reaches the driver.
    """
    links = materialize(
        pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    labels = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("_n")).select("id", F.least("id", "_n").alias("root")))
        for _ in range(2):
            up = step.select(F.col("id").alias("root"), F.col("root").alias("_up"))
            step = materialize(step.join(up, "root", "left").select("id", F.coalesce("_up", "root").alias("root")))
        if labels is None:
            labels = step
        else:
            up = step.select(F.col("id").alias("root"), F.col("root").alias("_up"))
            labels = materialize(labels.join(up, "root", "left").select("id", F.coalesce("_up", "root").alias("root")))
        left = step.select(F.col("id").alias("a"), F.col("root").alias("_a"))
        right = step.select(F.col("id").alias("b"), F.col("root").alias("_b"))
        links = materialize(
            links.join(left, "a").join(right, "b").where("_a <> _b")
            .select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
        )
    if labels is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return labels
