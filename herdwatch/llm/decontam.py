"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with documents.

An item's windows are its runs of 13 words (a shorter item is one window). A window is a set of word shingles
(runs of up to five words) and a document contains it only if it contains all of them, so one of them is
enough as prefix: the rarest in the corpus. Steps, all of them DataFrame functions:

1. one scan of the documents keeps where any shingle of the benchmark occurs (id, position, shingle);
2. shingles are ordered by the number of these rows, each window takes its rarest one as prefix;
3. rows of prefix shingles become candidates; position in the window and lengths must leave room for it;
4. the documents with candidates are read again, and every candidate is compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import NOT_WORD, only_ids, words

WINDOW, SHINGLE = 13, 5
# The benchmark's distinct shingles (16 bytes each) are broadcast up to this many, else shuffled.
BROADCAST_SHINGLES = 1_000_000


def runs(column: str, size: int) -> Column:
    """Rows (pos, token) of all runs of ``size`` words of an array column."""
    return F.when(
        F.size(column) >= size,
        F.transform(
            F.sequence(F.lit(0), F.size(column) - size),
            lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice(column, i + 1, size)).alias("token")),
        ),
    ).otherwise(F.array().cast("array<struct<pos:int,token:bigint>>"))


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows: (win, item ids). A window is its array of words."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col), NOT_WORD).alias("w"))
    items = items.where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    wins = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("win"))
    return wins.groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: int = 20,
) -> DataFrame:
    """Rows (id_col, n_words, n_hit, n_items, items_sha256, contaminated, items), one per document id.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. A word inside any occurrence of
    a window is hit; n_items counts the items with an occurring window, items lists them (as text, sorted), and
    items_sha256 is the digest of the list joined by commas (of the empty text if there is none). A document is
    contaminated if share * n_hit >= n_words and n_hit > 0. Null and empty texts have no words, items without
    words match nothing, equal items all count. Rows without an id share one row with a null id; rows that
    repeat an id give one row whose counts are those of the rows together (equal occurrences count once per row).
    Empty tables work on either side; other columns are not looked at.
    """
    windows = materialize(benchmark_windows(benchmark, item_col, item_text_col, window).withColumn("win_id", F.xxhash64("win")))
    sizes = [r[0] for r in windows.select(F.least(F.size("win"), F.lit(SHINGLE))).distinct().collect()] or [SHINGLE]

    # The windows' shingles: (token, win_id, offset), each with its place in the window.
    parts = [
        windows.where(F.least(F.size("win"), F.lit(SHINGLE)) == s).select("win_id", F.size("win").alias("len"), F.explode(runs("win", s)).alias("r"))
        for s in sorted(sizes)
    ]
    tokens = parts[0]
    for part in parts[1:]:
        tokens = tokens.unionByName(part)
    tokens = materialize(tokens.select("win_id", "len", F.col("r.token").alias("token"), F.col("r.pos").alias("offset")))
    known = materialize(tokens.select("token").distinct())
    if known.limit(BROADCAST_SHINGLES + 1).count() <= BROADCAST_SHINGLES:
        known = F.broadcast(known)

    # 1. One scan: a row per document with its length, and a row per occurrence of a shingle of the benchmark.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    split = texts.select("id", F.xxhash64("_text").alias("copy"), words(F.col("_text"), NOT_WORD).alias("w"))
    head = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("bigint").alias("token")))
    rows = split.select(
        "id", "copy", F.size("w").alias("n"), F.explode(F.concat(head, *[runs("w", s) for s in sorted(sizes)])).alias("r")
    )
    flat = rows.select("id", "copy", "n", F.col("r.pos").alias("pos"), F.col("r.token").alias("token"))
    seen = known.withColumn("hit", F.lit(True))
    found = materialize(
        flat.join(seen, "token", "left").where("pos = -1 or hit").select("id", "copy", "n", "pos", "token")
    )

    # 2. The rarest shingle of each window; a shingle that no document has rules its window out.
    often = found.where("pos >= 0").groupBy("token").count()
    ranked = tokens.join(often, "token", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    prefix = ranked.groupBy("win_id", "len").agg(F.min(F.struct("count", "token", "offset")).alias("m"))
    prefix = prefix.where("m.count > 0").select("win_id", "len", "m.token", "m.offset")

    # 3. Room for the window around the shingle.
    candidates = found.where("pos >= 0").join(prefix, "token").withColumn("start", F.col("pos") - F.col("offset"))
    candidates = candidates.where("start >= 0 and start + len <= n").select("id", "copy", "start", "win_id")
    candidates = materialize(candidates.join(windows.select("win_id", "win"), "win_id"))

    # 4. Word by word in the documents concerned.
    ids = materialize(candidates.where("id is not null").select("id").distinct())
    held = only_ids(texts.where("id is not null"), ids, "id")
    nameless = candidates.where("id is null").limit(1).count()
    if nameless:
        held = held.unionByName(texts.where("id is null"))
    per_text = candidates.groupBy("id", "copy").agg(F.collect_set(F.struct("start", "win_id", "win")).alias("c"))
    held = held.select(F.col("id").alias("_id"), F.xxhash64("_text").alias("_copy"), words(F.col("_text"), NOT_WORD).alias("w"))
    both = held.join(per_text, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_copy") == F.col("copy")))
    real = both.select(
        "id", "w",
        F.filter("c", lambda c: F.slice("w", c["start"] + 1, F.size(c["win"])) == c["win"]).alias("c"),
    ).where(F.size("c") > 0)
    spans = F.sort_array(F.transform("c", lambda c: F.struct(c["start"].alias("b"), (c["start"] + F.size(c["win"])).alias("e"))))
    covered = F.aggregate(
        spans, F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["total"] + F.greatest(s["e"] - F.greatest(s["b"], acc["end"]), F.lit(0))).alias("total"),
            F.greatest(acc["end"], s["e"]).alias("end"),
        ),
        lambda acc: acc["total"],
    )
    real = materialize(real.select("id", covered.alias("hit"), F.transform("c", lambda c: c["win_id"]).alias("wins")))
    hits = real.groupBy("id").agg(F.sum("hit").alias("n_hit"))
    named = (
        real.select("id", F.explode("wins").alias("win_id")).distinct().join(windows.select("win_id", "items"), "win_id")
        .select("id", F.explode("items").alias("item")).groupBy("id").agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    per_doc = hits.join(named, hits["id"].eqNullSafe(named["id"])).select(hits["id"].alias("_id"), "n_hit", "items")

    lengths = found.where("pos = -1").groupBy("id").agg(F.sum("n").cast("long").alias("n_words"))
    out = lengths.join(per_doc, F.col("id").eqNullSafe(F.col("_id")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), items.alias("items"),
    )
