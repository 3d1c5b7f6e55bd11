"""Places of rows in an order, and the k-th row of an order, without a window over all rows or over a hot group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import small

BROADCAST_PARTS = 200_000


def numbered(df: DataFrame, group: str, order: list[str | Column], out: str, total: str) -> DataFrame:
    """Adds the place of each row in its group (from 0) and the group's number of rows; the result is stored.

    Rows are dealt by ranges of (group, order) and sorted inside; each part's rows per group are counted, and the
    running sum of these few counts gives a part's first place. A null group is a group. Equal rows get
    different places, in any order.
    """
    ordered = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    # Number of the part and of the row inside it; fixed by storing it at once.
    kept = materialize(ordered.withColumn("_row", F.monotonically_increasing_id()))
    kept = kept.withColumn("_part", F.shiftright("_row", 33))
    counts = kept.groupBy("_part", F.col(group).alias("_group")).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    # A group has at most one row per part here.
    every = Window.partitionBy("_group")
    before = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col("_part").alias("_p"), "_group", "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(every).alias("_total"),
    )
    same = (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_group"))
    return kept.join(small(materialize(counts), BROADCAST_PARTS), same).select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("_row") - F.col("_first") + F.col("_before")).alias(out), F.col("_total").alias(total)
    )


def kth_key(rows: DataFrame, key: str, k: int, pivots: int = 15, seed: int = 0):
    """The k-th least value (from 1) of ``key``, a struct without nulls, among stored rows; None if k is out of range.

    Quickselect over the whole table: each round draws pivot keys from the rows still in question by a hash of
    the key, counts exactly how many of these rows lie below, on and above each pivot, and goes on between the two
    pivots that enclose the k-th. Only pivots and their counts reach the driver.
    """
    fields = rows.schema[key].dataType

    def literal(value):
        return F.struct(*[F.lit(value[f.name]).cast(f.dataType).alias(f.name) for f in fields.fields])

    low, high, left, turn = None, None, k, 0
    while True:
        open_ = rows
        if low is not None:
            open_ = open_.where(F.col(key) > literal(low))
        if high is not None:
            open_ = open_.where(F.col(key) < literal(high))
        # One task sends on at most the drawn rows.
        drawn = open_.select(key).orderBy(F.xxhash64(F.lit(seed + turn), key), key).limit(pivots).collect()
        pivot = sorted({tuple(r[key]): r[key] for r in drawn}.items())
        if not pivot or left < 1:
            return None
        sums = []
        for i, (_, value) in enumerate(pivot):
            sums.append(F.count_if(F.col(key) < literal(value)).alias(f"below_{i}"))
            sums.append(F.count_if(F.col(key) == literal(value)).alias(f"on_{i}"))
        found = open_.agg(F.count("*").alias("all"), *sums).first()
        if left > found["all"]:
            return None
        taken = 0
        for i, (_, value) in enumerate(pivot):
            below, on = found[f"below_{i}"], found[f"on_{i}"]
            if left <= below:
                high = value
                break
            if left <= below + on:
                return value
            low, taken = value, below + on
        left, turn = left - taken, turn + 1
