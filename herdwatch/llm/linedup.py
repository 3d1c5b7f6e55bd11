"""Cross-site boilerplate lines, found by their spread over sites.

Every line hash gets a HyperLogLog sketch of its sites; sketches merge in the aggregation. A line whose estimate
is clear of the threshold is decided by it; lines near the threshold get an exact count of distinct sites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import small

MIN_SITES = 5
# Sketch size (2^12 registers) and how many standard errors around the threshold are counted exactly.
LOG_K, ERRORS = 12, 6
# Boilerplate lines (8 bytes each) are broadcast up to this many.
BROADCAST_LINES = 1_000_000

BLANK = " \t\r\u000b\u000c"


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def drop_boilerplate(
    docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source"
) -> DataFrame:
    """Rows (id_col, n_lines, n_boiler, text), one per row: the text without its boilerplate lines.

    Lines are parted by line feeds and compared without the blanks around them. A line that is not blank and
    stands on ``min_sites`` distinct sites or more is boilerplate; all its occurrences go, the other lines stay as
    they are. A null site counts for no line, but its documents are cleaned. A null text stays null and has no
    lines, an empty one has one blank line. Repeated rows and null ids are cleaned like others. An empty table
    gives no rows; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(site_col).cast("string").alias("site"))
    rows = rows.withColumn("copy", F.xxhash64("text"))
    lines = (
        rows.where("text is not null").select("id", "copy", "site", F.posexplode(F.split("text", "\n")))
        .withColumn("line", stripped(F.col("col"))).where("line <> ''")
        .select("id", "copy", "site", "pos", F.xxhash64("line").alias("h"))
    )
    spread = lines.where("site is not null").groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_K))).alias("sites"))
    margin = max(1.0, ERRORS * 1.04 / 2 ** (LOG_K / 2) * min_sites)
    likely = materialize(spread.where(F.col("sites") >= min_sites - margin))
    near = likely.where(F.col("sites") < min_sites + margin).select("h")
    exact = (
        lines.where("site is not null").join(near, "h").select("h", "site").distinct()
        .groupBy("h").count().where(F.col("count") >= min_sites).select("h")
    )
    boiler = materialize(likely.where(F.col("sites") >= min_sites + margin).select("h").unionByName(exact))
    drops = (
        lines.join(small(boiler, BROADCAST_LINES), "h", "left_semi")
        .groupBy(F.col("id").alias("_id"), F.col("copy").alias("_copy")).agg(F.collect_set("pos").alias("drop"))
    )
    out = rows.join(drops, F.col("id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy")), "left")
    out = out.withColumn("_lines", F.split("text", "\n")).withColumn("drop", F.coalesce("drop", F.array().cast("array<int>")))
    return out.select(
        F.col("id").alias(id_col), F.coalesce(F.greatest(F.size("_lines"), F.lit(0)), F.lit(0)).cast("long").alias("n_lines"),
        F.size("drop").cast("long").alias("n_boiler"),
        F.array_join(F.filter("_lines", lambda line, i: ~F.array_contains("drop", i)), "\n").alias("text"),
    )
