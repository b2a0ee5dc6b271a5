"""From raw documents to token ids in five stages, each by one of the training-data operators.

Every stage works on all rows its predecessor kept:

1. language: the language becomes the prediction; rows of no learned language go;
2. near_dedup: of each class of near-duplicates (80 %) the smallest id stays;
3. decontaminate: documents that hold a benchmark item go;
4. pii: personal data in the text is replaced by its kind in brackets;
5. tokens: byte-level BPE ids of what is left, decoded again as a check.

Stages 1 to 4 return the columns of documents, whatever they are; stage 5
returns doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256, round_trip
and token_ids.  Nulls, empty texts, repeated rows and empty tables follow the
operators' own rules: null and empty texts have no language and go in stage 1.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom.llm import bpe, decontam, langid, neardup, pii
from diffloom.llm.common import read, shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accept_languages(docs, langid.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact_pii(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("lang", "source"))


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", redact), ("tokens", tokens)]

#: The stages learn models and compare texts in ways SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; a stage's folder goes when the next one is whole."""
    docs, top, before = read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{top}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
