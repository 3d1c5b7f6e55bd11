"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Each document gets the key -ln(u) / weight, u uniform from a digest of its id and weight its quality, so that the
least keys of a source are a weighted sample without replacement. A source's documents are taken whole: as many
complete epochs as its target holds, then documents in key order until the rest of the target is filled.

The prefix sums need no sort of a source: sizes are summed per (source, bin of the key), the bins' running sum
shows the one bin in which the target ends, and only that bin's documents (a 4,096th of the source or so) are
sorted and summed one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import BLANKS, small

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BINS = 4_096
BROADCAST_SOURCES, BROADCAST_CUT = 100_000, 1_000_000
OWN = ("_mix_id", "_mix_copy", "_mix_source", "_mix_size", "_mix_key", "_mix_bin")


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")).cast("long")


def letter_share(text: Column) -> Column:
    """A quality weight between 0.25 and 1: more for a larger share of letters."""
    letters = F.length(F.regexp_replace(text, r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", ""))
    return F.when(F.length(text) > 0, 0.25 + 0.75 * letters / F.length(text)).otherwise(F.lit(0.25))


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, quality: Column | None, seed: int) -> DataFrame:
    """Adds the columns of ``OWN``: id, hash of the text, source, words, key and its bin."""
    text = F.col(text_col)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") + 1) / float(2**52)
    weight = F.greatest(F.coalesce(letter_share(text) if quality is None else quality, F.lit(0.0)), F.lit(1e-6))
    out = docs.withColumns({
        "_mix_id": F.col(id_col), "_mix_copy": F.xxhash64(text), "_mix_source": F.col(source_col).cast("string"),
        "_mix_size": n_words(text), "_mix_key": -F.log(u) / weight,
    })
    return out.withColumn("_mix_bin", F.floor(F.col("_mix_key") / (1 + F.col("_mix_key")) * BINS).cast("int"))


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(source, source_size) rows with their target: shares by weight, at most ``most`` sizes, the excess reshared.

    Sources fill up in the order of cap / weight; the level at which the first one does not fill is everyone's.
    """
    all_rows = Window.partitionBy()
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sources.withColumn("w", weight).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("_source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("all", share * F.sum("source_size").over(all_rows))
    level = (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0))
    )
    t = t.withColumn("rank", F.row_number().over(order)).withColumn("level", level)
    first = F.min(F.when(F.col("cap") > F.col("level") * F.col("w"), F.struct("rank", "level"))).over(all_rows)
    t = t.withColumn("first", first)
    target = F.when(F.col("rank") < F.coalesce(F.col("first.rank"), F.lit(2**31 - 1)), F.col("cap").cast("double")).otherwise(
        F.col("first.level") * F.col("w")
    )
    return t.select("_source", "source_size", target.alias("target"))


def with_copies(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, quality: Column | None,
    weights: tuple[int, ...], share: float, most: int, seed: int, with_rows: bool,
) -> DataFrame:
    """The rows (or only the columns of ``OWN``) with _mix_source_size, _mix_target and _mix_copies."""
    slim = materialize(keyed(docs, id_col, text_col, source_col, quality, seed).select(*OWN))
    named = slim.select(*[F.col(c).alias(c.removeprefix("_mix")) for c in OWN])
    bins = materialize(named.groupBy("_source", "_bin").agg(F.sum("_size").alias("size")))
    plan = targets(bins.groupBy("_source").agg(F.sum("size").alias("source_size")), weights, share, most)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))

    # The bin in which the rest ends, and what is left of the rest there.
    running = Window.partitionBy("_source").orderBy("_bin")
    ends = bins.withColumn("end", F.sum("size").over(running)).withColumnRenamed("_source", "_s")
    ends = ends.join(plan.select("_source", "rest"), F.col("_s").eqNullSafe(F.col("_source"))).where("end > rest")
    cut = ends.groupBy("_s").agg(F.min(F.struct("_bin", (F.col("rest") - (F.col("end") - F.col("size"))).alias("left"))).alias("m"))
    cut = cut.select("_s", F.col("m._bin").alias("cut"), F.col("m.left").alias("left"))
    plan = plan.join(cut, F.col("_source").eqNullSafe(F.col("_s")), "left").select(
        F.col("_source").alias("_mix_ps"), F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target"),
        F.col("epochs").alias("_mix_epochs"), F.col("cut").alias("_mix_cut"), F.col("left").alias("_mix_left"),
    )
    plan = small(materialize(plan), BROADCAST_SOURCES)

    # Documents of those bins, rows of one id and text as one.
    same_source = F.col("_mix_source").eqNullSafe(F.col("_mix_ps"))
    same = ["_mix_source", "_mix_id", "_mix_copy", "_mix_key"]
    edge = slim.join(plan, same_source).where("_mix_bin = _mix_cut").groupBy(*same).agg(
        F.sum("_mix_size").alias("size"), F.first("_mix_left").alias("left")
    )
    before = Window.partitionBy("_mix_source").orderBy("_mix_key", "_mix_id", "_mix_copy").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    edge = edge.where(F.col("before") + F.col("size") / 2 <= F.col("left"))
    edge = edge.select(F.col("_mix_id").alias("_mix_ei"), F.col("_mix_copy").alias("_mix_ec"), F.col("_mix_source").alias("_mix_es"))
    edge = small(materialize(edge), BROADCAST_CUT).withColumn("_mix_in", F.lit(1))

    rows = keyed(docs, id_col, text_col, source_col, quality, seed) if with_rows else slim
    in_edge = (
        F.col("_mix_id").eqNullSafe(F.col("_mix_ei")) & (F.col("_mix_copy") == F.col("_mix_ec"))
        & F.col("_mix_source").eqNullSafe(F.col("_mix_es"))
    )
    out = rows.join(plan, same_source).join(edge, in_edge, "left")
    more = (
        F.when(F.col("_mix_cut").isNull() | (F.col("_mix_bin") < F.col("_mix_cut")), 1)
        .when(F.col("_mix_bin") == F.col("_mix_cut"), F.coalesce("_mix_in", F.lit(0))).otherwise(0)
    )
    copies = F.col("_mix_epochs") + F.when(F.col("_mix_epochs") >= most, 0).otherwise(more)
    return out.withColumn("_mix_copies", copies.cast("int"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    quality: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 0,
) -> DataFrame:
    """Rows (id_col, size, source_size, target, copies, taken), one per row of ``docs``.

    Sources by code point, null last, get ``weights`` in turn and share ``share`` times the words of all
    documents, none above ``most`` times its own words. A document is taken ``copies`` times, complete epochs
    first; at the end of a source's target the documents in key order go in while at least half of them fits,
    so a source's words differ from its target by at most half of one document. taken is copies * size. A null
    text has no words. A null source is a source. Rows that repeat an id and text are taken or left together;
    rows without an id share one key and go by their texts. Reruns agree: keys depend on ids and ``seed`` alone.
    An empty table gives no rows; other columns are not looked at.
    """
    out = with_copies(docs, id_col, text_col, source_col, quality, weights, share, most, seed, with_rows=False)
    return out.select(
        F.col("_mix_id").alias(id_col), F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"), F.col("_mix_copies").alias("copies"),
        (F.col("_mix_copies") * F.col("_mix_size")).alias("taken"),
    )


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    quality: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 0,
) -> DataFrame:
    """The mix itself: all columns of ``docs``, whatever their names, every row as often as ``mix`` takes it."""
    # Names that no working column has.
    inner = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()], *([] if quality is None else [quality.alias("_in_quality")]))
    out = with_copies(
        rows, inner[id_col], inner[text_col], inner[source_col], None if quality is None else F.col("_in_quality"),
        weights, share, most, seed, with_rows=True,
    )
    out = out.withColumn("_mix_each", F.explode(F.array_repeat(F.lit(1), F.col("_mix_copies"))))
    return out.select(*[F.col(n).alias(c) for c, n in inner.items()])
