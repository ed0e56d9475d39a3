"""The queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near_vectors, packing, pieces, private_data, quality_rules, resampling, secrets, shingle_join, token_output, toxicity
from .common import Stored, documents


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return resampling.resample(documents(spark, sf_dir), labels, Stored(spark))


def op4_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_data.scan(documents(spark, sf_dir), Stored(spark))
    counts = [F.expr(f"cast(size(filter(base, x -> x.rank = {i})) as long)").alias(f"n_{kind}") for i, kind in enumerate(private_data.KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(private_data.listed("base"), 256).alias("base_sha256"), private_data.listed("spans").alias("spans"))


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Stored(spark))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(quality_rules.ledger(documents(spark, sf_dir), Stored(spark)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed", "policy", "base_failed", "kept")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6's ablations, from its ledger."""
    return quality_rules.ablations(quality_rules.ledger(documents(spark, sf_dir), Stored(spark)))


def op7_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.near_duplicates(documents(spark, sf_dir), Stored(spark))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_output.encode_write(spark, documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return token_output.map_documents(spark, path, lambda ids: [len(ids), zlib.crc32(ids.astype("<u4").tobytes())], "n_tokens long, ids_crc32 long")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_decode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir), Stored(spark))
    base = F.expr("filter(spans, x -> x.kind <> 'random')")
    found = found.withColumn("base", base)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.listed("base"), 256).alias("base_sha256"), secrets.listed("spans").alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_toxicity": op2_toxicity,
    "op3_resampling": op3_resampling,
    "op4_private_data": op4_private_data,
    "op5_near_vectors": op5_near_vectors,
    "op6_quality_rules": op6_quality_rules,
    "op7_shingle_join": op7_shingle_join,
    "op8_token_output": op8_token_output,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_secrets": op10_secrets,
    "quality_ablations": quality_ablations,
}
ORACLE_SQL: dict[str, str] = {"op6_quality_rules": quality_rules.SQL, "quality_ablations": quality_rules.ABLATIONS_SQL}
