"""The queries opN_ of this subpackage and, where SQL expresses them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import exact_dedup, fm_dedup, language_id, license_scan, merkle, mixing, oracles, piece_codec, simhash, suffix_dedup, toxicity
from .common import documents, fold


def tokenizer(name: str = "piece_bpe_32k.model") -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Classifier:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.fit(documents(spark, sf_dir).select("doc_id", "text"), labels.where(fold(n=5) != 0))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", (fold(n=5) == 0).alias("held_out"), "text")
    return toxicity.score(docs, toxicity_model(spark, sf_dir)).select("doc_id", "held_out", "score", "predicted")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold(n=4) == 2
    dictionaries = language_id.fit(docs, ~held_out)
    return language_id.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), dictionaries)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(documents(spark, sf_dir).select("doc_id", "text"), telling=license_scan.TELLING)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.groups(documents(spark, sf_dir), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup.remove(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_report(documents(spark, sf_dir)).drop("edits")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", F.col("source_size").cast("bigint").alias("source_size"), F.round("target", 4).alias("target"), "taken")


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return piece_codec.encode_documents(docs, tokenizer()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_language_id": op3_language_id,
    "op4_license_scan": op4_license_scan,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_merkle": op7_merkle,
    "op8_mixing": op8_mixing,
    "op9_piece_codec": op9_piece_codec,
    "op10_simhash": op10_simhash,
}
ORACLES = {"op1_suffix_dedup": oracles.OP1, "op4_license_scan": oracles.OP4, "op6_substring_dedup": oracles.OP6, "op5_exact_dedup": oracles.OP5, "op7_merkle": oracles.OP7, "op8_mixing": oracles.OP8}
