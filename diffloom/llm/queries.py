"""Registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, hostrules, langid, lm, neardup, oracle, pii, quality, secrets, tokenbin
from .common import read


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marginal probability of every whole text."""
    return lm.score_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text."""
    return secrets.secret_digest(secrets.find_secrets(read(spark, sf_dir, "documents")))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, decoded again."""
    docs = read(spark, sf_dir, "documents")
    out = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip")


def op4_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document at 85 %."""
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), percent=85)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text."""
    return langid.identify_languages(read(spark, sf_dir, "documents"))


def op6_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text."""
    scanned = pii.scan(read(spark, sf_dir, "documents"))
    return pii.pii_digest(pii.find_pii(scanned, pii.train(scanned)))


def op7_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole document."""
    docs = read(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    return tokenbin.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and host verdicts for every document."""
    return hostrules.host_quality(read(spark, sf_dir, "documents"))


def op10_simhash_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in every whole document."""
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lattice_lm, op2_entropy_secrets, op3_byte_bpe, op4_minhash_neardup, op5_language_id, op6_weak_pii, op7_quality_cotraining, op8_token_binary, op9_host_rules, op10_simhash_decontam)}


def oracle_sql() -> dict[str, str]:
    """Those whose results SQL can express; tests hold the others against brute force."""
    return {"op4_minhash_neardup": oracle.NEAR_DUPLICATES, "op9_host_rules": oracle.HOST_RULES}
