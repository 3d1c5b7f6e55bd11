"""Rejection of unknown languages, scores by hand, sketches of short texts, ids of many texts at once."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("herdwatch.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

from herdwatch.llm import langid, neardup, tokenbin  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


# --- language --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").cache()


@pytest.mark.parametrize("unlearnt", ["fr", "de", "es"])
def test_texts_of_an_unlearnt_language_are_rejected(rows, unlearnt):
    """Half or more of its texts go, and 99 of 100 of the learnt languages stay."""
    known = rows.withColumn("true", F.col("lang")).withColumn("lang", F.when(F.col("lang") != unlearnt, F.col("lang")))
    out = langid.identify(known).join(known.select("doc_id", "true"), "doc_id").where("lang_pred <> 'und'").toPandas()
    strange = out["true"] == unlearnt
    assert strange.sum() > 50 and out.loc[strange, "rejected"].mean() >= 0.5
    assert out.loc[~strange & out["true"].notna(), "rejected"].mean() <= 0.01


def test_shuffled_bytes_are_rejected_and_clean_texts_stay(spark, rows):
    kept = langid.accepted(rows).count()
    named = langid.identify(rows).where("lang_pred <> 'und'")
    assert kept >= 0.99 * named.count() and kept == named.where("not rejected").count()
    rng = random.Random(3)
    long = [r["text"] for r in rows.where("length(text) > 300").limit(40).collect()]
    odd = []
    for i, text in enumerate(long):
        letters = list(text.lower())
        rng.shuffle(letters)
        odd.append((100_000 + i, "".join(letters), None))
    both = rows.unionByName(spark.createDataFrame(odd, rows.schema))
    out = langid.identify(both).where("doc_id >= 100000").collect()
    assert np.mean([r["rejected"] for r in out]) >= 0.9


def plain_prediction(model, text):
    """Language, score and deviation of one text, subword by subword."""
    words = re.sub(r"[\W\d_]+", " ", (text or "").lower()).split()
    if not words:
        return langid.UNKNOWN, 0.0, 0.0
    buckets = []
    for word in words:
        b = b" " + word.encode() + b" "
        for size, times in ((3, 0x9E3779B1), (4, 0x85EBCA77)):
            for i in range(len(b) - size + 1):
                number = int.from_bytes(b[i : i + size], "little") * times % 2**32
                buckets.append(number >> (32 - langid.BUCKETS.bit_length() + 1))
    z = [float(b) for b in model.bias]
    for j in range(len(z)):
        z[j] += sum(float(model.table[k, j]) for k in buckets) / max(len(buckets), 1)
    p = np.exp((np.array(z) - max(z)) / model.temperature)
    best = int(np.argmax(p))
    share = sum(float(model.usual[k, best]) for k in buckets) / max(len(buckets), 1)
    far = (share - model.mean[best]) / np.sqrt(model.between[best] + model.within[best] / max(len(buckets), 1)) if buckets else 0.0
    return model.languages[best], float(p[best] / p.sum()), far


def test_predictions_by_hand(spark, rows):
    model = langid.fit_on(rows, "doc_id", "text", "lang")
    odd = [(10**6, None, None), (10**6 + 1, "", None), (10**6 + 2, "a", None), (10**6 + 3, "12 _ .", None), (10**6 + 4, "Äß ü\nx", None), (10**6 + 5, "ok " * 50_000, None)]
    some = rows.where("doc_id % 10 = 0").unionByName(spark.createDataFrame(odd, rows.schema))
    got = {r["doc_id"]: r for r in langid.identify(rows.unionByName(spark.createDataFrame(odd, rows.schema))).collect()}
    for r in some.collect():
        name, score, far = plain_prediction(model, r["text"])
        out = got[r["doc_id"]]
        assert out["lang_pred"] == name and out["score"] == pytest.approx(score, abs=1e-6)
        if abs(far - model.threshold) > 1e-6:
            assert out["rejected"] == (name == langid.UNKNOWN or far < model.threshold)


def test_only_one_language_is_learnt(rows):
    one = rows.where("lang = 'en' or lang is null")
    out = langid.identify(one).where("lang_pred <> 'und'").collect()
    assert {r["lang_pred"] for r in out} == {"en"} and np.mean([r["rejected"] for r in out]) < 0.05


# --- sketches --------------------------------------------------------------------------------------------------


def plain_sketch(values, coords):
    """Round by round, every shingle in every round."""
    out = np.full(coords, neardup.MAX)
    shift, low = np.uint64(64 - int(np.log2(coords))), np.uint64((1 << 48) - 1)
    for i in range(2 * coords if len(values) else 0):
        h = neardup.mix(values + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        bins = (h >> shift).astype(np.int64) if i < coords else np.full(len(h), i - coords)
        np.minimum.at(out, bins, (h & low) | np.uint64(i << 48))
    return out


@pytest.mark.parametrize("coords", [16, 64, 1024])
def test_sketches_equal_plain_rounds(coords):
    rng = np.random.default_rng(coords)
    lengths = np.array([0, 1, 2, 3, 0, 7, 40, 700, 3, 0])
    values = rng.integers(0, 2**63, lengths.sum()).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    ends = np.cumsum(lengths)
    want = [plain_sketch(values[e - n : e], coords) for e, n in zip(ends, lengths)]
    assert (neardup.sketches(values, lengths, coords) == np.stack(want)).all()


def test_many_short_texts_are_sketched_in_time(spark):
    rng = np.random.default_rng(1)
    start = time.process_time()
    for _ in range(5):
        assert (neardup.sketches(rng.integers(0, 2**63, 6_000).astype(np.uint64), np.full(2_000, 3)) < neardup.MAX).all()
    assert time.process_time() - start < 10
    words = [f"w{i}" for i in range(50)]
    pick = random.Random(2)
    texts = [" ".join(pick.choices(words, k=7)) for _ in range(1500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[:300]])], "doc_id long, text string")
    out = neardup.near_duplicates(df).where("not kept").count()
    assert out >= 300


def test_batches_of_short_texts_are_cut_by_rows():
    sets = pa.array([[i, i + 1, i + 2] for i in range(5000)], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000), pa.int64()), sets], names=["id", "set"])
    sizes = [len(b) for b in neardup.signatures([batch])]
    assert sum(sizes) == 5000 and max(sizes) <= neardup.ROWS


# --- token ids -------------------------------------------------------------------------------------------------


ODD = [
    "", " ", "a", " a", "a ", "a  b", "a b", "x\ny", "x \ny", "x\n y", " a b", "a  b", "a  b", "it's we'll  don't", "<|endoftext|> x", "日本 語", "é ü 😀 ok",
    "tab\tx y", "1234 5678", "\x1c x", "x\x0b y", "a " * 3000 + "end", "\u0085 a", "a \u0085", "ȀɏɐZ a", "_ __ a_b",
]


@pytest.mark.parametrize("together", [4 << 20, 50])
def test_many_texts_at_once_give_the_librarys_ids(spark, monkeypatch, together):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(6)
    texts = [*ODD, *["".join(rng.choices("ab 1'\n\té .,Z", k=rng.randint(0, 60))) for _ in range(400)]]
    encoder = tokenbin.encoder(path)
    tail = np.array([2], "<u4").tobytes()
    for chunk in (texts, texts[:1], []):
        data, ends = encoder.encode_all(pa.array(chunk, pa.string()), tail)
        begins = [0, *ends[:-1]]
        for text, a, b in zip(chunk, begins, ends, strict=bool(chunk)):
            assert np.frombuffer(data[a:b], "<u4").tolist() == [*encoder.library.encode(text, add_special_tokens=False).ids, 2], repr(text)
    # Words that are remembered, and the memory running over.
    monkeypatch.setattr(tokenbin, "REMEMBERED", 20)
    fresh = tokenbin.Encoder(path)
    for at in range(0, len(texts), 30):
        chunk = texts[at : at + 30]
        assert fresh.encode_all(pa.array(chunk), tail)[0] == b"".join(encoder.whole(t) + tail for t in chunk)
    assert fresh.encode_all(pa.array(["ok it's dogs' (well) Élan, naïve's x", "  "]), tail)[0] == b"".join(encoder.whole(t) + tail for t in ["ok it's dogs' (well) Élan, naïve's x", "  "])
    sliced = pa.array(["zzz", *texts], pa.string()).slice(1)
    assert encoder.encode_all(sliced, tail)[0] == encoder.encode_all(pa.array(texts), tail)[0]
