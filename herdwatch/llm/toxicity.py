"""Toxicity by class-conditional Kneser-Ney models.

A word is read as a bigram of its stem (the first four characters) and its rest, so that an expression seen
once says something about its other endings. Each class c (toxic, ordinary) has its own counts C_c; what lies
below them is shared by the classes:

    P_c(word) = P_c(stem) * P_c(rest | stem)
    P_c(stem) = (max(C_c(stem) - D, 0) + (discounted from all stems in c) * P(stem)) / N_c
    P_c(rest | stem) = (max(C_c(stem, rest) - D, 0) + (discounted from the stem's rests in c) * P(rest)) / C_c(stem)

P(stem) is the stem's share of all counts, and P(rest) the share of all distinct words that end in it (the
continuation count). A stem that a class has never seen leaves P(rest) alone. The discount D = 2 leaves nothing
of an expression that a class has seen once or twice: the shared counts speak for it, so that the smaller class
isn't credited with chance. Counts are sums over the labelled rows of the language-model part and grow with them.

The difference log P_toxic - log P_ordinary is worked out once per word and stored. Where no class has a word more
than D times, P(rest) cancels out and the stem's difference is the word's; where no class has a stem more than D
times, all of it cancels but the classes' discounted shares. So only the other words and stems are stored, and
nothing is lost. The most frequent of them are broadcast, up to documented sizes; those beyond are joined to the
distinct words and stems of each text, so that every entry counts at every size.

A text's length-normalised difference of log-likelihoods, the best 24-word window of it, and the sums of its
words' differences above 1, 3 and 5 enter a logistic regression, fitted on a bounded sample of the other labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import BROADCAST_IDS, NOT_WORD, small, words
from .langid import held_out

STEM, DISCOUNT, SPAN, STRONG = 4, 2, 24, (1, 3, 5)
FEATURES = 2 + len(STRONG)
# Entries that are broadcast (the others are joined), rows that fit the regression, labels that are broadcast.
MOST_WORDS, MOST_STEMS = 300_000, 100_000
SAMPLE, BROADCAST_LABELS = 20_000, 1_000_000
PREDICT = 0.7
CHUNK = 1 << 20


@dataclass
class Table:
    """Values by 64-bit key."""

    keys: np.ndarray
    values: np.ndarray

    def put(self, keys: np.ndarray, out: np.ndarray) -> None:
        """Sets ``out`` where a key is in the table."""
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            found = self.keys[at] == keys
            out[found] = self.values[at[found]]


@dataclass
class Model:
    words: Table  # log P_toxic - log P_ordinary of the most frequent words
    stems: Table  # the same of words that are not stored, by stem
    unseen: float  # the same of words whose stem is not stored
    weights: np.ndarray | None = None

    def ratios(self, stem: np.ndarray, word: np.ndarray, more: tuple[Table, Table] | None) -> np.ndarray:
        """log P_toxic - log P_ordinary of each word; ``more`` has words and stems that are not broadcast."""
        out = np.full(len(word), self.unseen)
        self.stems.put(stem, out)
        if more:
            more[1].put(stem, out)
        self.words.put(word, out)
        if more:
            more[0].put(word, out)
        return out

    def features(self, stem: np.ndarray, word: np.ndarray, lengths: np.ndarray, more: tuple[Table, Table] | None) -> np.ndarray:
        """Per text: mean ratio, best window's mean, logs of the strong words' sums."""
        out = np.zeros((len(lengths), FEATURES))
        ends = np.cumsum(lengths)
        start = 0
        while start < len(lengths):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
            r = self.ratios(stem[base : ends[stop - 1]], word[base : ends[stop - 1]], more)
            total = np.concatenate([[0], np.cumsum(r)])
            strong = [np.concatenate([[0], np.cumsum(np.maximum(r - least, 0))]) for least in STRONG]
            for i in range(start, stop):
                a, b = (ends[i] - lengths[i] - base), ends[i] - base
                if a == b:
                    continue
                k = min(SPAN, b - a)
                windows = total[a + k : b + 1] - total[a : b + 1 - k]
                sums = [np.log1p(max(x[b] - x[a], 0)) for x in strong]
                out[i] = (total[b] - total[a]) / (b - a), windows.max() / k, *sums
            start = stop
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights[1:] + self.weights[0], -30, 30)))


def hashed(docs: DataFrame, *columns: str, rests: bool = False) -> DataFrame:
    """Adds arrays _s, _w, and _r if wanted: hashes of the stems, words and rests of column _text."""
    df = docs.withColumn("_words", words(F.col("_text"), NOT_WORD))
    lists = [
        F.transform("_words", lambda w: F.xxhash64(F.substring(w, 1, STEM))).alias("_s"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_w"),
    ]
    if rests:
        lists.append(F.transform("_words", lambda w: F.xxhash64(F.substring(w, F.lit(STEM + 1), F.length(w)))).alias("_r"))
    return df.select(*columns, *lists)


def frequent(df: DataFrame, bound: int) -> Column:
    """Whether n is at least the least power of 2^(1/4) that leaves at most ``bound`` rows."""
    step = F.floor(F.log2("n") * 4).cast("int")
    steps = df.groupBy(step.alias("step")).count().collect()
    taken, least = 0, 1 + max((row["step"] for row in steps), default=0)
    for row in sorted(steps, key=lambda r: -r["step"]):
        taken += row["count"]
        if taken > bound:
            break
        least = row["step"]
    return step >= least


def to_table(df: DataFrame) -> Table:
    got = df.select("h", "ratio").toArrow()
    keys, values = (got.column(c).to_numpy() for c in ("h", "ratio"))
    order = np.argsort(keys)
    return Table(keys[order], values[order])


def count_model(rows: DataFrame) -> tuple[Model, DataFrame | None]:
    """Counts all rows (_text, toxic): the model, and rows (is_word, h, ratio) that are not broadcast, None without any."""
    df = hashed(rows, "toxic", rests=True)
    each = df.select("toxic", F.explode(F.arrays_zip("_s", "_r", "_w")).alias("x")).select("toxic", "x._s", "x._r", "x._w")
    t, o = F.sum("toxic"), F.sum(1 - F.col("toxic"))
    counts = materialize(each.groupBy("_s", "_r", "_w").agg(t.alias("t"), o.alias("o")))
    both = [F.sum("t").alias("st"), F.sum("o").alias("so"), F.sum(F.least("t", F.lit(DISCOUNT))).alias("dt"), F.sum(F.least("o", F.lit(DISCOUNT))).alias("do")]
    stems = materialize(counts.groupBy("_s").agg(*both))
    rests = materialize(counts.groupBy("_r").agg(F.count("*").alias("endings")))
    got = stems.agg(F.sum("st"), F.sum("so"), F.sum(F.least("st", F.lit(DISCOUNT))), F.sum(F.least("so", F.lit(DISCOUNT)))).first()
    totals, distinct = [float(x or 0) for x in got], counts.count()

    def over(column: str) -> Column:
        return F.greatest(F.col(column) - DISCOUNT, F.lit(0))

    p_stem = (F.col("st") + F.col("so") + 0.5) / (totals[0] + totals[1] + 1)
    p_rest = (F.col("endings") + 0.5) / (distinct + 1)
    first = [F.log((over(s) + (totals[2 + c] + 1) * p_stem) / (totals[c] + 1)) for c, s in enumerate(("st", "so"))]
    kept = [F.when(F.col(d) > 0, F.log(F.col(d) / F.col(s))).otherwise(0.0) for d, s in (("dt", "st"), ("do", "so"))]
    second = [
        F.log(F.when(F.col(d) > 0, (over(w) + F.col(d) * p_rest) / F.col(s)).otherwise(p_rest))
        for w, d, s in (("t", "dt", "st"), ("o", "do", "so"))
    ]
    by_stem = stems.where(F.greatest("st", "so") > DISCOUNT).select(
        F.lit(False).alias("is_word"), F.col("_s").alias("h"), (F.col("st") + F.col("so")).alias("n"), (first[0] - first[1] + kept[0] - kept[1]).alias("ratio")
    )
    often = counts.where(F.greatest("t", "o") > DISCOUNT)
    by_word = often.join(small(stems, BROADCAST_IDS), "_s").join(small(rests, BROADCAST_IDS), "_r").select(
        F.lit(True).alias("is_word"), F.col("_w").alias("h"), (F.col("t") + F.col("o")).alias("n"), (first[0] - first[1] + second[0] - second[1]).alias("ratio")
    )
    stored = materialize(by_word.unionByName(by_stem))
    near, far = [], []
    for part, bound in ((stored.where("is_word"), MOST_WORDS), (stored.where("not is_word"), MOST_STEMS)):
        sent = frequent(part, bound)
        near.append(to_table(part.where(sent)))
        far.append(part.where(~sent).select("is_word", "h", "ratio"))
    rest = far[0].unionByName(far[1])
    unseen = np.log((totals[2] + 1) / (totals[0] + 1)) - np.log((totals[3] + 1) / (totals[1] + 1))
    return Model(*near, float(unseen)), None if rest.isEmpty() else rest


def with_rest(docs: DataFrame, shared, rest: DataFrame) -> DataFrame:
    """Adds _more: what ``rest`` has of the text's words and stems.

    Each text's distinct words and stems that are not broadcast meet ``rest`` once; equal texts share one list.
    """
    key = [F.xxhash64(F.coalesce("_text", F.lit(""))).alias("_k"), F.xxhash64(F.lit("second"), F.coalesce("_text", F.lit(""))).alias("_k2")]
    keyed = docs.select("*", *key)

    def missing(batches):
        for batch in batches:
            k, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_k", "_k2"))
            lengths = np.diff(batch.column("_w").offsets.to_numpy())
            at = np.repeat(np.arange(len(lengths)), lengths)
            stem, word = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("_s", "_w"))
            shared.value.words.put(word, known_word := np.full(len(word), np.nan))
            shared.value.stems.put(stem, known_stem := np.full(len(word), np.nan))
            left = np.isnan(known_word)
            for is_word, hashes, here in ((True, word, left), (False, stem, left & np.isnan(known_stem))):
                row, h = at[here], hashes[here]
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
                row, h = row[new], h[new]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k[row]), pa.array(k2[row]), pa.array(np.full(len(h), is_word)), pa.array(h)], names=["_k", "_k2", "is_word", "h"]
                )

    asked = hashed(keyed, "_k", "_k2").mapInArrow(missing, "_k long, _k2 long, is_word boolean, h long").distinct()
    found = asked.join(rest, ["is_word", "h"]).groupBy("_k", "_k2").agg(F.collect_list(F.struct("is_word", "h", "ratio")).alias("_more"))
    return keyed.join(found, ["_k", "_k2"], "left").select(*docs.columns, F.coalesce("_more", F.array().cast(dict(found.dtypes)["_more"])).alias("_more"))


def featured(docs: DataFrame, model: Model, rest: DataFrame | None, *columns: str) -> DataFrame:
    """Columns and the text's features f0, f1, ..."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    joined = rest is not None
    df = hashed(with_rest(docs, shared, rest), *columns, "_more") if joined else hashed(docs, *columns)

    def run(batches):
        for batch in batches:
            more = None
            if joined:
                got = batch.column("_more").flatten()
                is_word, h, ratio = (got.field(j).to_numpy(zero_copy_only=False) for j in range(3))
                more = []
                for here in (is_word, ~is_word):
                    keys, first = np.unique(h[here], return_index=True)
                    more.append(Table(keys, ratio[here][first]))
            lists = [batch.column(c) for c in ("_s", "_w")]
            lengths = np.diff(lists[0].offsets.to_numpy())
            found = shared.value.features(*[x.flatten().to_numpy(zero_copy_only=False) for x in lists], lengths, more)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *[pa.array(found[:, j]) for j in range(FEATURES)]], names=[*columns, *[f"f{j}" for j in range(FEATURES)]])

    schema = df.select(*columns).schema
    for j in range(FEATURES):
        schema = schema.add(f"f{j}", "double")
    return df.mapInArrow(run, schema)


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps; the classes weigh as they come."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    keep = ridge * np.diag([1e-6, *[1.0] * x.shape[1]])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + keep, a.T @ (p - y) + keep @ w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE
) -> DataFrame:
    """Rows (id_col, held_out, score, predicted), one per row of ``docs``.

    Of labelled rows that are not held out (crc32 of the id modulo 3 is not 1), four fifths by hash of the id give the
    counts and the others the regression (at most about ``sample`` rows of them). Scores look at texts only. Null and empty
    texts have no words and get the score of an empty text. Rows that are labelled twice count twice; a label
    that is null counts for nothing; rows without an id are held out. Without rows of both classes in either part
    all scores are 0. An empty table gives no rows; other columns are not looked at.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    marks = marks.where(~held_out("id")).withColumn("fold", (F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(5)) == 0).cast("int"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))

    def labelled(fold: int, share: float = 1.0) -> DataFrame:
        part = marks.where(F.col("fold") == fold)
        if share < 1:
            part = part.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30) < share)
        return texts.join(small(part.select("id", "toxic"), BROADCAST_LABELS), "id")

    sizes = {(r["fold"], r["toxic"]): r["count"] for r in marks.groupBy("fold", "toxic").count().collect()}
    flag = held_out("id").alias("held_out")
    if min(sizes.get((f, c), 0) for f in (0, 1) for c in (0, 1)) == 0:
        return texts.select(F.col("id").alias(id_col), flag, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    model, rest = count_model(labelled(0))
    fit = featured(labelled(1, sample / (sizes[1, 0] + sizes[1, 1])), model, rest, "toxic").toPandas()
    # A fixed order, whatever order the rows came in.
    names = [f"f{j}" for j in range(FEATURES)]
    fit = fit.sort_values([*names, "toxic"])
    if fit["toxic"].nunique() < 2:
        return texts.select(F.col("id").alias(id_col), flag, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    model.weights = regression(fit[names].to_numpy(), fit["toxic"].to_numpy())
    found = featured(texts, model, rest, "id")
    z = F.lit(float(model.weights[0]))
    for j in range(FEATURES):
        z = z + float(model.weights[j + 1]) * F.col(f"f{j}")
    out = found.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0)))))
    return out.select(F.col("id").alias(id_col), flag, "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))
