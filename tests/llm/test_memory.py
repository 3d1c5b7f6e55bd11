"""What bounds the memory of an executor and its Python workers."""

from __future__ import annotations

import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from herdwatch.llm import tokenbin
from herdwatch.session import BATCH_BYTES, BATCH_KEY, short_batches

# Lives as long as anything that was allocated from it.
COUNTED = pa.proxy_memory_pool(pa.default_memory_pool())
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture
def unbounded(spark):
    before = spark.conf.get(BATCH_KEY, None)
    spark.conf.unset(BATCH_KEY)
    yield spark
    spark.conf.unset(BATCH_KEY) if before is None else spark.conf.set(BATCH_KEY, before)


def largest_batch(df):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["size"])

    return df.mapInArrow(sizes, "size long").agg(F.max("size")).first()[0]


@pytest.mark.parametrize("stage", ["language_id", "minhash_dedup", "token_binary"])
def test_stages_with_python_bound_the_bytes_of_a_batch(unbounded, stage):
    spark = unbounded
    long = spark.range(3000).repartition(1).select(F.repeat(F.lit("some words "), 300).alias("text"))
    assert largest_batch(long) > 4 * BATCH_BYTES
    docs = spark.createDataFrame(
        [(i, f"the text number {i} of a few words", "en", "web", 30) for i in range(6)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    dict(corpus_pipeline.STAGES)[stage](spark, docs, "")
    assert largest_batch(long) < 1.5 * BATCH_BYTES


def test_a_bound_of_the_session_stays(unbounded):
    unbounded.conf.set(BATCH_KEY, "7m")
    short_batches(unbounded)
    assert unbounded.conf.get(BATCH_KEY) == "7m"


def test_few_words_are_looked_up_without_a_table_of_all_remembered_ones():
    encoder = tokenbin.Encoder(VOCABULARY)
    n = 400_000
    encoder.names = pa.array([f"word{i}" for i in range(n)], pa.string())
    encoder.codes = pa.array([i.to_bytes(4, "little") for i in range(n)], pa.large_binary())
    before = pa.default_memory_pool()
    pa.set_memory_pool(COUNTED)
    try:
        found = encoder.remembered(pa.array([f"word{i}" for i in (7, n - 1, 0)], pa.string()))
    finally:
        pa.set_memory_pool(before)
    assert [int.from_bytes(x, "little") for x in found.to_pylist()] == [7, n - 1, 0]
    # Four bytes a remembered word and a little; a table of them all takes some 12 MB more.
    assert COUNTED.max_memory() < 6 << 20


def test_remembered_and_new_words_mix_in_any_order():
    encoder, asked = tokenbin.Encoder(VOCABULARY), tokenbin.Encoder(VOCABULARY)
    encoder.remembered(pa.array(["river", "stone", "zebra"], pa.string()))
    words = ["quartz", "zebra", "lantern", "river", "fjord"]
    found = encoder.remembered(pa.array(words, pa.string())).to_pylist()
    assert found == [asked.whole(f" {w}") for w in words]
    assert encoder.names.to_pylist() == ["river", "stone", "zebra", "quartz", "lantern", "fjord"]
