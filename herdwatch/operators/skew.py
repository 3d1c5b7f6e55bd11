"""Ordered windows over keys of any size.

A window partitioned by animal puts all readings of one animal into one task. When one
animal holds a large share of a huge table, that task cannot finish. The functions here cut
the rows of such a hot key into order-preserving chunks, and hand each chunk the few rows
(or the one carried value) it needs from its neighbours as extra *ghost* rows. The window
then runs per (key, chunk) and the ghosts are dropped, so the result is the same as over
the whole key.

Keys are counted first (one map-side combined aggregation over the key columns only). When
no key is larger than ``max_rows`` nothing is added and the plan is the plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

# Rows of one key one task may sort.
HOT_KEY_ROWS = 4_000_000
# A hot (key, chunk) is cut at this many quantiles at a time.
CUTS = 63
# Numbers of the order that one level looks at.
AT_A_TIME = 8
# Hot (key, chunk) pairs (some 500 bytes each) are broadcast up to this many.
BROADCAST_HOT = 50_000
# Cells of missing values and of NaN, which sort first and last.
FIRST_CELL, LAST_CELL = -1, 1 << 20

CHUNK, GHOST, SIDE = "_chunk", "_ghost", "_side"


def positions(df: DataFrame, name: str) -> list[Callable[[], Column]]:
    """A column as numbers that sort alike, each as a double that holds it exactly.

    Microseconds, days, the halves of whole numbers, or the text six bytes at a time, to its end. Columns are made when
    they are asked for, as a long text has many.
    """
    kind = dict(df.dtypes)[name]
    if kind.startswith("timestamp"):
        return [lambda: F.unix_micros(F.col(name).cast("timestamp")).cast("double")]
    if kind == "date":
        return [lambda: F.unix_date(F.col(name)).cast("double")]
    if kind == "bigint":
        # Beyond 2^53 neighbours would be the same double.
        return [lambda: F.shiftright(name, 32).cast("double"), lambda: F.col(name).bitwiseAND(F.lit(0xFFFFFFFF)).cast("double")]
    if kind == "string":
        longest = df.agg(F.max(F.octet_length(name))).first()[0] or 0

        def part(start: int) -> Column:
            digits = F.hex(F.encode(F.col(name), "UTF-8"))
            return F.conv(F.rpad(F.substring(digits, start, 12), 12, "0"), 16, 10).cast("double")

        return [partial(part, start) for start in range(1, 2 * longest + 1, 12)] or [lambda: F.lit(0.0)]
    return [lambda: F.col(name).cast("double")]


def _join_hot(rows: DataFrame, hot: DataFrame, group: Sequence[str], how: str) -> DataFrame:
    """Join rows with a stored table of hot groups, null-safely; broadcast if its counted size allows."""
    same = F.lit(True)
    for g in group:
        same = same & rows[g].eqNullSafe(hot[f"_hot_{g}"])
    if hot.limit(BROADCAST_HOT + 1).count() <= BROADCAST_HOT:
        hot = F.broadcast(hot)
    return rows.join(hot, same, how)


def _cuts_up_to(df: DataFrame) -> DataFrame:
    """Adds ``_upto``, how many of the at most CUTS ascending ``_cuts`` are not above ``_place``, by halving.

    A step is a column of its own, which generated code computes once; a lambda over the cuts is interpreted, and looks at all.
    """
    df, step = df.withColumn("_upto", F.lit(0)), 1 << (CUTS.bit_length() - 1)
    while step:
        fits = F.coalesce(F.get("_cuts", F.col("_upto") + (step - 1)) <= F.col("_place"), F.lit(False))
        df, step = df.withColumn("_upto", F.col("_upto") + F.when(fits, step).otherwise(0)), step // 2
    return df


def add_chunks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], max_rows: int | None = None
) -> DataFrame | None:
    """Number the rows of every hot key by order-preserving chunks in column ``_chunk``.

    ``None`` means that no key exceeds ``max_rows``, or none that does can be cut. A hot key is cut at
    quantiles of the first order column that varies within it; the rows that equal a quantile are a chunk of
    their own. A chunk that is still too large is cut again, until it fits or its rows are equal in all order
    columns. Each level reads the rows twice (sizes, quantiles of the hot ones), and its table of hot
    (key, chunk) pairs, at most ``rows / max_rows``, is stored, so that reads grow linearly with the levels.
    A level looks at a few numbers at a time (see ``positions``); where no hot chunk varies in them, at the next ones.
    """
    max_rows = max_rows or HOT_KEY_ROWS
    out = df.withColumn(CHUNK, F.expr("CAST(array() AS ARRAY<BIGINT>)"))
    group, numbered, level, at = [*keys, CHUNK], None, 0, 0
    while True:
        sizes = out.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_rows)
        if sizes.isEmpty():
            return None if level == 0 else out
        hot = materialize(sizes.select(*[F.col(g).alias(f"_hot_{g}") for g in group]))
        if numbered is None:
            numbered = [place for c in order for place in positions(df, c)]
        places = [place() for place in numbered[at : at + AT_A_TIME]]
        numbers = out.select(*group, *[place.alias(f"_p{i}") for i, place in enumerate(places)])
        plan = _join_hot(numbers, hot, group, "inner").groupBy(*group)
        aggs, pick = [F.count(F.lit(1)).alias("_n")], F.lit(None).cast("int")
        for i in range(len(places)):
            known = F.when(~F.isnan(f"_p{i}"), F.col(f"_p{i}"))
            aggs += [
                F.min(known).alias(f"_lo{i}"), F.max(known).alias(f"_hi{i}"), F.count(known).alias(f"_some{i}"),
                F.count_if(F.isnan(f"_p{i}")).alias(f"_nan{i}"),
                F.percentile_approx(known, [(j + 1) / (CUTS + 1) for j in range(CUTS)], 10_000).alias(f"_cuts{i}"),
            ]
        for i in reversed(range(len(places))):
            kinds = [F.col(f"_some{i}"), F.col(f"_nan{i}"), F.col("_n") - F.col(f"_some{i}") - F.col(f"_nan{i}")]
            mixed = sum(F.when(k > 0, 1).otherwise(0) for k in kinds) > 1
            pick = F.when((F.col(f"_lo{i}") < F.col(f"_hi{i}")) | mixed, F.lit(i)).otherwise(pick)
        cuts = F.element_at(F.array(*[F.col(f"_cuts{i}") for i in range(len(places))]), F.col("_pick") + 1)
        plan = materialize(
            plan.agg(*aggs).withColumn("_pick", pick).filter(F.col("_pick").isNotNull()).select(
                *[F.col(g).alias(f"_hot_{g}") for g in group], "_pick",
                F.array_sort(F.array_distinct(F.coalesce(cuts, F.array().cast("array<double>")))).alias("_cuts"),
            )
        )
        if plan.isEmpty():
            at += AT_A_TIME
            if at < len(numbered):
                continue
            return None if level == 0 else out
        joined = _join_hot(out, plan, group, "left")
        place = F.element_at(F.array(*places), F.col("_pick") + 1) if len(places) > 1 else places[0]
        joined = _cuts_up_to(joined.withColumn("_place", place))
        at_cut = F.coalesce(F.get("_cuts", F.col("_upto") - 1) == F.col("_place"), F.lit(False))
        # Cuts below the place and cuts up to it.
        below = 2 * F.col("_upto") - F.when(at_cut, 1).otherwise(0)
        cell = F.when(F.col("_place").isNull(), FIRST_CELL).when(F.isnan("_place"), LAST_CELL).otherwise(below).cast("long")
        out = joined.withColumn(
            CHUNK, F.when(F.col("_pick").isNotNull(), F.concat(CHUNK, F.array(cell))).otherwise(F.col(CHUNK))
        ).select(*df.columns, CHUNK)
        level += 1


@dataclass(frozen=True)
class Prepared:
    """Rows ready for an ordered window: use ``window`` to build it, ``finish`` afterwards."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    columns: tuple[str, ...]
    chunked: bool

    def partition(self) -> WindowSpec:
        return W.partitionBy(*self.keys, *([CHUNK] if self.chunked else []))

    def window(self) -> WindowSpec:
        return self.partition().orderBy(*([SIDE] if self.chunked else []), *self.order)

    def finish(self, df: DataFrame) -> DataFrame:
        if not self.chunked:
            return df
        return df.filter(~F.col(GHOST)).drop(CHUNK, GHOST, SIDE)


def with_previous_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, max_rows: int | None = None
) -> Prepared:
    """Prepare ``df`` for windows that look back at most ``rows`` rows within a key."""
    keys, order = tuple(keys), tuple(order)
    chunked = add_chunks(df, keys, order, max_rows)
    if chunked is None:
        return Prepared(df, keys, order, tuple(df.columns), False)
    last_first = [F.col(c).desc() for c in order]
    tail = (
        chunked.filter(F.size(CHUNK) > 0)
        .withColumn("_rank", F.row_number().over(W.partitionBy(*keys, CHUNK).orderBy(*last_first)))
        .filter(F.col("_rank") <= rows)
        .drop("_rank")
    )
    # Per hot key: `rows` rows of each chunk, so a small share of the key.
    along = W.partitionBy(*keys).orderBy(CHUNK, *order)
    before = F.lag(CHUNK).over(along)
    ghosts = (
        tail.withColumn("_opens", F.when(before.isNull() | (before != F.col(CHUNK)), F.col(CHUNK)))
        .withColumn("_next", F.collect_list("_opens").over(along.rowsBetween(1, rows)))
        .withColumn(CHUNK, F.explode("_next"))
        .select(*chunked.columns)
        .withColumn(GHOST, F.lit(True))
    )
    both = chunked.withColumn(GHOST, F.lit(False)).unionByName(ghosts).withColumn(SIDE, F.lit(0))
    return Prepared(both, keys, order, tuple(df.columns), True)


def with_nearest_values(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str],
    max_rows: int | None = None,
) -> Prepared:
    """Prepare ``df`` for "last known value before" / "first known value after" windows."""
    keys, order = tuple(keys), tuple(order)
    chunked = add_chunks(df, keys, order, max_rows)
    if chunked is None:
        return Prepared(df, keys, order, tuple(df.columns), False)
    known = [
        agg(F.when(F.col(v).isNotNull(), F.struct(*order, F.col(v).alias("_value")))).alias(f"{tag}{v}")
        for v in values
        for agg, tag in ((F.max, "_last_"), (F.min, "_first_"))
    ]
    along = W.partitionBy(*keys).orderBy(CHUNK)
    earlier = along.rowsBetween(W.unboundedPreceding, -1)
    later = along.rowsBetween(1, W.unboundedFollowing)
    ends = chunked.filter(F.size(CHUNK) > 0).groupBy(*keys, CHUNK).agg(*known)
    near = ends.withColumns(
        {
            **{f"_before_{v}": F.last(f"_last_{v}", ignorenulls=True).over(earlier) for v in values},
            **{f"_after_{v}": F.first(f"_first_{v}", ignorenulls=True).over(later) for v in values},
        }
    )
    sides = near.select(
        *keys, CHUNK,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(side).alias(SIDE), *[F.col(f"_{where}_{v}")["_value"].alias(v) for v in values]
                    )
                    for side, where in ((-1, "before"), (1, "after"))
                ]
            )
        ),
    )
    both = (
        chunked.withColumn(SIDE, F.lit(0))
        .withColumn(GHOST, F.lit(False))
        .unionByName(sides.withColumn(GHOST, F.lit(True)), allowMissingColumns=True)
    )
    return Prepared(both, keys, order, tuple(df.columns), True)


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str, into: str, max_rows: int | None = None
) -> DataFrame:
    """Add the running sum of ``weight`` within each key, in order, as column ``into``."""
    keys, order = tuple(keys), tuple(order)
    chunked = add_chunks(df, keys, order, max_rows)
    if chunked is None:
        so_far = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn(into, F.sum(weight).over(so_far))
    sums = chunked.groupBy(*keys, CHUNK).agg(F.sum(weight).alias("_sum"))
    earlier = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    ghosts = sums.select(
        *keys, CHUNK, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias(weight), F.lit(-1).alias(SIDE)
    )
    both = chunked.withColumn(SIDE, F.lit(0)).unionByName(ghosts, allowMissingColumns=True)
    so_far = W.partitionBy(*keys, CHUNK).orderBy(SIDE, *order).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(into, F.sum(weight).over(so_far)).filter(F.col(SIDE) == 0).drop(CHUNK, SIDE)
