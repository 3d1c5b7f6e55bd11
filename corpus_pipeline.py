"""A training corpus from the documents table: stages, each written as Parquet and read again by the next.

Every stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all rows its predecessor kept; all but the last
return the columns of ``documents``. There is no SQL for the whole, as SQL cannot train the language model of the first
stage; the tests compare each stage with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herdwatch.llm import decontam, langid, mixing, neardup, tokenbin
from herdwatch.llm.common import BROADCAST_IDS, small
from herdwatch.llm.queries import table, vocabulary
from herdwatch.session import materialize, write_and_read

ORACLE_SQL = None


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is not in ``ids``; rows without an id stay."""
    return docs.join(small(materialize(ids), BROADCAST_IDS), "doc_id", "left_anti").select(*docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those whose language is too uncertain."""
    return langid.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the least id."""
    found = neardup.near_duplicates(docs)
    return without(docs, found.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more stands in the benchmark."""
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.where("contaminated and doc_id is not null").select("doc_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that the sources' words meet their targets."""
    return mixing.mixed(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token ids and returns what the files hold: doc_id, start, n_tokens, ids_crc32."""
    return tokenbin.round_trip(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language_id", keep_known_languages),
    ("minhash_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix_sources),
    ("token_binary", write_token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_and_read(stage(spark, docs, sf_dir), name)
    return docs
