"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are runs of three and four UTF-8 bytes of the lower-cased words, one blank at either side included, hashed
into buckets. A text is the average of its subwords' embeddings, a linear layer and a softmax give the languages.
Embeddings and layer are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows; a
temperature and the rejection threshold are fitted on other rows of the sample. For scoring, embeddings and
layer are multiplied out to one table (bucket x language).

A softmax is sure of itself on languages it has never seen, so rejection looks at something else: how usual the text's
subwords are in the language it was given, as the mean log-share of their buckets there, measured in deviations of
known texts with as many subwords. The threshold is calibrated from both sides: on rows of the learnt languages, of
which hardly any may be rejected, and on texts of no learnt language, for which stand the same rows with their own
language left out, and with their bytes shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import short_batches

# Rows used to fit the classifier: a documented bound, spread over the languages. A quarter calibrates.
SAMPLE = 3_000
BUCKETS, DIM = 1 << 13, 16
# Of calibration texts of learnt languages, this share may be rejected; of those of no learnt one, this share should be.
REJECTED, CAUGHT = 0.001, 0.9
# Weight of the even distribution in a language's shares of buckets.
EVEN = 0.02
# Bytes, and texts, that are looked at in one go.
CHUNK, SLICE = 1 << 18, 500

UNKNOWN = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")
TIMES = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77))


def held_out(id_col: str) -> Column:
    """Rows no label of which may be learnt: crc32 of the id as text leaves 1 when divided by 3. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def letters(text: str | None) -> bytes:
    """Lower-cased words between single blanks, as UTF-8; empty if there is no letter."""
    plain = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {plain} ".encode() if plain else b""


def subwords(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, position) of every subword in a run of bytes; none reaches over a blank."""
    b = np.frombuffer(data, np.uint8)
    if len(b) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    w, blank = b.astype(np.uint32), b == 32
    three = w[:-2] | w[1:-1] << np.uint32(8) | w[2:] << np.uint32(16)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    at = np.flatnonzero(~blank[1:-1])
    out, where = [(three[at] * TIMES[0]) >> shift], [at]
    if len(b) > 3:
        at = np.flatnonzero(~(blank[1:-2] | blank[2:-1]))
        out.append(((three[at] | w[at + 3] << np.uint32(24)) * TIMES[1]) >> shift)
        where.append(at)
    return np.concatenate(out).astype(np.int64), np.concatenate(where)


def shuffled(data: bytes) -> bytes:
    """The same bytes in another order, blanks left where they are; always the same order for the same text."""
    out = np.frombuffer(data, np.uint8).copy()
    at = np.flatnonzero(out != 32)
    out[at] = out[np.random.default_rng(len(data)).permutation(at)]
    return out.tobytes()


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket x language
    bias: np.ndarray
    usual: np.ndarray  # log-share of a bucket in a language
    mean: np.ndarray  # of known texts' mean log-shares, by language
    within: np.ndarray  # variance of a single subword's log-share
    between: np.ndarray  # variance of texts' means beyond that
    temperature: float = 1.0
    threshold: float = -np.inf

    def deviations(self, share: np.ndarray, n: np.ndarray, language: np.ndarray) -> np.ndarray:
        """How far mean log-shares of texts of n subwords are from those of known texts of the language."""
        return (share - self.mean[language]) / np.sqrt(self.between[language] + self.within[language] / np.maximum(n, 1))

    def logits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(logits, deviations for the best language); a text without subwords deviates by nothing."""
        out, far = np.tile(self.bias, (len(texts), 1)), np.zeros(len(texts))
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop]) <= CHUNK):
                size += len(texts[stop])
                stop += 1
            # Texts start and end with a blank, so no subword reaches into the next.
            bucket, where = subwords(b"".join(texts[start:stop]))
            doc = np.repeat(np.arange(stop - start), [len(t) for t in texts[start:stop]])[where]
            n = np.bincount(doc, minlength=stop - start)
            for j in range(len(self.languages)):
                out[start:stop, j] += np.bincount(doc, self.table[bucket, j], minlength=stop - start) / np.maximum(n, 1)
            best = out[start:stop].argmax(axis=1)
            share = np.bincount(doc, self.usual[bucket, best[doc]], minlength=stop - start) / np.maximum(n, 1)
            far[start:stop] = np.where(n > 0, self.deviations(share, n, best), 0.0)
            start = stop
        return out, far

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(languages, scores, deviations)."""
        data = [letters(t) for t in texts]
        z, far = self.logits(data)
        p = softmax(z / self.temperature)
        best = p.argmax(axis=1)
        names = [self.languages[k] if d else UNKNOWN for k, d in zip(best, data, strict=True)]
        return names, np.where([bool(d) for d in data], p.max(axis=1), 0.0), far


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


Bag = tuple[np.ndarray, np.ndarray]


def matrix_of(bags: list[Bag]) -> tuple[np.ndarray, np.ndarray]:
    """(shares of buckets, number of subwords) by text."""
    x = np.zeros((len(bags), BUCKETS), np.float32)
    for i, (bucket, count) in enumerate(bags):
        x[i, bucket] = count / max(count.sum(), 1)
    return x, np.array([count.sum() for _, count in bags])


def train(bags: list[Bag], noise: list[Bag | None], labels: list[str], epochs: int = 40, batch: int = 32) -> Model:
    """Fits on bags (buckets of one text and their counts), calibrates on those that ``noise`` has with shuffled bytes."""
    languages = sorted(set(labels))
    y = np.array([languages.index(label) for label in labels])
    rng = np.random.default_rng(11)
    x, n = matrix_of(bags)
    apart = np.array([b is not None for b in noise])
    if apart.all():
        apart[:] = False
    fit, rest = rng.permutation(np.flatnonzero(~apart)), np.flatnonzero(apart)
    embed = rng.normal(0, 1, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    steps, done = epochs * max(1, -(-len(fit) // batch)), 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(fit), max(1, -(-len(fit) // batch))):
            rate = 1 - done / steps
            xb = x[part]
            hidden = xb @ embed
            wrong = softmax(hidden @ layer + bias)
            wrong[np.arange(len(part)), y[part]] -= 1
            wrong /= len(part)
            back = wrong @ layer.T
            # Steps are cut, so that few and odd texts cannot make the fit diverge.
            layer -= np.clip(2 * rate * hidden.T @ wrong, -1, 1)
            bias -= 0.5 * rate * wrong.sum(axis=0)
            # Averages spread a step over many buckets, so their rate is larger.
            embed -= np.clip(200 * rate * xb.T @ back, -1, 1)
            done += 1
    belongs = np.zeros((len(bags), len(languages)), np.float32)
    belongs[fit, y[fit]] = 1
    share = x.T @ (belongs / np.maximum(belongs.sum(axis=0), 1))
    share[:, belongs.sum(axis=0) == 0] = 1 / BUCKETS
    usual = np.log((share + EVEN / BUCKETS) / (1 + EVEN)).astype(np.float64)
    mean = (share * usual).sum(axis=0)
    within = (share * (usual - mean) ** 2).sum(axis=0)
    model = Model(languages, (embed @ layer).astype(np.float64), bias.astype(np.float64), usual, mean, within, np.full(len(languages), 0.05))
    if len(rest):
        calibrate(model, x[rest].astype(np.float64), n[rest], y[rest], *matrix_of([noise[i] for i in rest]))
    return model


def calibrate(model: Model, x: np.ndarray, n: np.ndarray, y: np.ndarray, odd: np.ndarray, n_odd: np.ndarray) -> None:
    """Sets temperature, deviations and threshold on texts that were not fitted; ``odd`` has them with shuffled bytes."""
    z = x @ model.table + model.bias
    grid = np.geomspace(0.3, 5, 40)
    loss = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    share = x @ model.usual
    for j in range(len(model.languages)):
        own = share[(y == j) & (n > 0), j]
        if len(own) > 1:
            model.mean[j] = own.mean()
            model.between[j] = max(own.var() - (model.within[j] / n[(y == j) & (n > 0)]).mean(), 0.01)

    def best_of(z: np.ndarray, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        best = z.argmax(axis=1)
        return model.deviations((x @ model.usual)[np.arange(len(x)), best], n, best)[n > 0]

    known = best_of(z, x, n)
    strange = [best_of(odd @ model.table + model.bias, odd, n_odd)]
    if len(model.languages) > 1:
        without = z.copy()
        without[np.arange(len(y)), y] = -np.inf
        strange.append(best_of(without, x, n))
    strange = np.concatenate(strange)
    if len(known):
        least = np.quantile(known, REJECTED)
        # Half-way between known and strange texts, where they lie apart.
        usual_end = np.quantile(strange, CAUGHT) if len(strange) else least
        model.threshold = float(min(least, (least + usual_end) / 2))


def counted(batches):
    """Batches (lang, text, apart) to (lang, first, bucket, count) and, for texts set apart, the same with shuffled bytes.

    At most one count per bucket, however long the text.
    """
    for batch in batches:
        lists = [[] for _ in range(5)]
        for text, apart in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = letters(text)
            bag = subwords(data)[0]
            for at, some in ((1, bag), (3, subwords(shuffled(data))[0] if apart else None)):
                found, n = (None, None) if some is None else np.unique(some, return_counts=True)
                lists[at].append(found if some is None else found.astype(np.int16))
                lists[at + 1].append(n if some is None else n.astype(np.int32))
            lists[0].append(int(bag[0]) if len(bag) else -1)
        kinds = [pa.int32(), pa.list_(pa.int16()), pa.list_(pa.int32()), pa.list_(pa.int16()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(x, k) for x, k in zip(lists, kinds, strict=True)]],
            names=["lang", "first", "bucket", "count", "odd", "odd_count"],
        )


def fit_on(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE) -> Model | None:
    """A model from at most about ``sample`` labelled rows that are not held out; None without any."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(~held_out("id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = sample / len(counts)
    rate = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, share / n))])
    u = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30)
    # One row per id, so that an id that repeats often is not the whole sample.
    drawn = rows.where(u < F.element_at(rate, F.col("lang"))).groupBy("id").agg(F.min(F.struct("lang", "text")).alias("m"))
    apart = F.pmod(F.xxhash64(F.lit("calibration"), "id"), F.lit(4)) == 0
    got = drawn.select("m.lang", "m.text", apart.alias("apart")).mapInArrow(
        counted, "lang string, first int, bucket array<smallint>, count array<int>, odd array<smallint>, odd_count array<int>"
    ).toArrow()

    def bags(bucket: str, count: str) -> list[Bag | None]:
        lists = []
        for name in (bucket, count):
            column = got.column(name).combine_chunks()
            lists.append(np.split(column.values.to_numpy(), column.offsets.to_numpy()[1:-1]) if len(column) else [])
        known = got.column(bucket).is_valid().to_pylist()
        return [(b, n) if ok else None for b, n, ok in zip(*lists, known, strict=True)]

    bag, noise = bags("bucket", "count"), bags("odd", "odd_count")
    labels, first = got.column("lang").to_pylist(), got.column("first").to_pylist()
    used = [i for i in range(len(bag)) if len(bag[i][0])]
    if not used:
        return None
    # A fixed order, whatever order the rows came in.
    used.sort(key=lambda i: (labels[i], int(bag[i][1].sum()), int(bag[i][0].astype(np.int64) @ bag[i][1]), first[i]))
    return train([bag[i] for i in used], [noise[i] for i in used], [labels[i] for i in used])


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE
) -> DataFrame:
    """Rows (id_col, held_out, lang_pred, score, rejected), one per row of ``docs``.

    Learns from rows with a language whose id's crc32 is not 1 modulo 3; scores look at texts only. A text that is
    null or has no letter is "und" with score 0 and rejected; others get a learnt language, and are rejected if
    their subwords are less usual in it than the calibrated threshold. Without any labelled row every text is "und". Rows without an
    id count as held out; repeated rows each get a row; an empty table gives no rows; other columns are not looked at.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(fit_on(docs, id_col, text_col, lang_col, sample))

    def run(batches):
        for batch in batches:
            names, score, low = judge(shared.value, batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(low, pa.bool_())],
                names=[id_col, "held_out", "lang_pred", "score", "rejected"],
            )

    schema = rows.select(id_col, "held_out").schema
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("rejected", "boolean")):
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)


def accepted(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE
) -> DataFrame:
    """The rows that ``identify`` does not reject, with all their columns; only the texts pass through Python."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit_on(docs, id_col, text_col, lang_col, sample))

    @F.arrow_udf("boolean")
    def known(text: pa.Array) -> pa.Array:
        return pa.array(~judge(shared.value, text)[2])

    return docs.where(known(F.col(f"`{text_col}`").cast("string")))


def judge(model: Model | None, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, scores, rejected) of texts; without a model nothing is known."""
    if model is None:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    parts = [model.predict(texts.slice(i, SLICE).to_pylist()) for i in range(0, max(len(texts), 1), SLICE)]
    names = [name for part in parts for name in part[0]]
    score, far = (np.concatenate([part[j] for part in parts]) for j in (1, 2))
    return names, score, np.array([n == UNKNOWN for n in names], bool) | (far < model.threshold)
