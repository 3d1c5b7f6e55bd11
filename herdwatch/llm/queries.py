"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    ann, chat, decontam, langid, linedup, merkle, mixing, neardup, oracles, resample, tokenbin, tokencount, toxicity, vectors,
)


def vocabulary(name: str) -> str:
    """The path of a public tokenizer file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted and read back."""
    said = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.digests(chat.format_conversations(rows.unionByName(more)))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked vectors among all embeddings."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to binary blocks and read back."""
    return tokenbin.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    return langid.identify(table(spark, sf_dir, "documents")).drop("rejected")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that stand on five sites or more."""
    out = linedup.drop_boilerplate(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_lines", "n_boiler", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256")
    )


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents."""
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op11_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th vector among all embeddings."""
    return ann.nearest_by_product(table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, with a version for each tampered one."""
    return merkle.manifest(table(spark, sf_dir, "documents")).drop("source", "n_copied")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents resampled towards the benchmark's distribution."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_chat_format,
        op3_minhash_dedup,
        op4_embedding_dedup,
        op5_token_binary,
        op6_toxicity,
        op7_language_id,
        op8_line_dedup,
        op9_mix_sources,
        op10_token_counts,
        op11_ann,
        op12_merkle_manifest,
        op13_resample,
    )
}

ORACLES: dict[str, str] = {
    "op1_decontaminate": oracles.DECONTAMINATE,
    "op2_chat_format": oracles.FORMAT_CHAT,
    "op3_minhash_dedup": oracles.NEAR_DUPLICATES,
    "op8_line_dedup": oracles.DROP_BOILERPLATE,
    "op9_mix_sources": oracles.MIX,
    "op12_merkle_manifest": oracles.MERKLE,
    "op13_resample": oracles.RESAMPLE,
}
