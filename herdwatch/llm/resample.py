"""Importance resampling towards a target distribution.

A text's features are its words and pairs of words, hashed into buckets. The ratio of a bucket's smoothed shares in the
target and in the corpus is its gain; all gains form one array, and a document's weight is the mean of its features'
entries. Weight and a Gumbel number from a digest of the id give the score, and the documents with the
highest scores are a draw without replacement. The last score that is drawn is found by a distributed quickselect
on the composite key (score, id); only the winners are sorted and ranked.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ranks import kth_key, numbered

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
# Bytes of a text that are parted into words at a time.
PIECE = 1 << 20

# A-Z in lower case; every other ASCII character but digits and letters separates words.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def features(text: bytes):
    """Yields (words, buckets of the words and word pairs that end there) for pieces of a UTF-8 text."""
    plain, start, last = text.translate(PLAIN), 0, None
    while start < len(plain):
        stop = plain.find(b" ", start + PIECE)
        stop = len(plain) if stop < 0 else stop
        words = plain[start:stop].split()
        start = stop
        if words:
            single = list(map(crc32, words))
            # The checksum of a pair goes on from that of its first word.
            first = single[:-1] if last is None else [last, *single[:-1]]
            pairs = list(map(crc32, [b" " + w for w in (words[1:] if last is None else words)], first))
            last = single[-1]
            yield len(words), np.array(single + pairs, np.int64) % BUCKETS


def bucket_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """Rows (bucket, n): features of all texts, summed per task first."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, found in features(text.as_py() or b""):
                    total += np.bincount(found, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    texts = docs.select(F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str, target_text_col: str) -> np.ndarray:
    """floor(1000 ln) of (t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS)) by bucket: as many numbers as buckets."""
    s = bucket_counts(docs, text_col).withColumnRenamed("n", "s")
    t = bucket_counts(target, target_text_col).withColumnRenamed("n", "t")
    both = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left")
    both = materialize(both.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")]))
    sums = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    ratio = ((F.col("t") + 1) * (sums["s"] + BUCKETS)) / ((F.col("s") + 1) * (sums["t"] + BUCKETS))
    rows = both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for row in rows:
        out[row["bucket"]] = row["gain"]
    return out


def weights(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, n_words, n_features, weight), one per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        gain = shared.value
        for batch in batches:
            out = np.zeros((3, len(batch)), np.int64)
            for i, text in enumerate(batch.column(1)):
                for n, found in features(text.as_py() or b""):
                    out[:, i] += n, len(found), gain[found].sum()
            # Whole numbers, so that the mean is floored exactly.
            out[2] //= np.maximum(out[1], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], names=["id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, "id long, n_words long, n_features long, weight long")


def gumbel(id_: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of a digest of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32)))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
    percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """Rows (id_col, n_words, n_features, weight, score, rank), one per row of ``docs``.

    Of the N rows with at least ``least_words`` words, the floor(percent * N / 100) with the highest scores are
    drawn: their rank is 1, 2, 3... in that order, ties to the smaller id, rows without an id after all others; rank is
    null for the rest. A text that is null or without words has no features and weight 0. Rows that repeat an id
    count one by one; equal ones are drawn in any order. An empty corpus gives no rows; an empty target leaves the
    smoothed shares. Other columns are not looked at.
    """
    scored = weights(docs, gains(docs, target, text_col, target_text_col), id_col, text_col)
    scored = scored.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
    key = F.struct((-F.col("score")).alias("s"), F.col("id").isNull().cast("int").alias("none"), F.coalesce("id", F.lit(0)).alias("id"))
    scored = materialize(scored.withColumn("key", key))
    may = scored.where(F.col("n_words") >= least_words)
    k = percent * may.count() // 100
    last = kth_key(may, "key", k) if k else None
    columns = ["id", "n_words", "n_features", "weight", "score"]
    no_rank = F.lit(None).cast("long").alias("rank")
    if last is None:
        out = scored.select(*columns, no_rank)
    else:
        drawn = (F.col("n_words") >= least_words) & (F.col("key") <= F.struct(*[F.lit(last[c]).cast(t).alias(c) for c, t in (("s", "long"), ("none", "int"), ("id", "long"))]))
        one = scored.where(drawn).select(*columns, "key", F.lit(0).alias("all"))
        place = numbered(one, "all", ["key"], "place", "total")
        # Rows equal to the last one may be more than are drawn.
        ranked = place.select(*columns, F.when(F.col("place") < k, F.col("place") + 1).alias("rank"))
        out = scored.where(~drawn).select(*columns, no_rank).unionByName(ranked)
    return out.withColumnRenamed("id", id_col)
