"""A training-data pipeline over `documents`: each stage calls one operator and hands its rows on as Parquet.

Stages, in order: quality rules (rejected documents go), near-dedup (of documents whose five-word
shingles have a similarity of 0.8 or more, directly or by steps, one stays), benchmark decontamination (documents with a benchmark passage go), secret scans
(secrets in texts are replaced by a mark), SentencePiece encoding (doc_id, ids and their figures).
All but the last return the columns of documents.

Defined results: null and empty texts have no words, so the quality rules drop them; given to a later stage
they pass as they are. Of repeated rows and of documents that tie as copies the least doc_id stays, and of rows
alike in id and words any one. Texts of any length are taken whole. An empty table gives no rows. Other columns
are passed on, whatever their names, up to the last stage. Stage tables are written to the shared folder; each is
deleted once the stage after it has been written.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import decontaminate, near_dup, quality, secret_scan, sentencepiece_codec
from cadenza.llm.storage import discard, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, secret_scan.learn(docs))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

#: SQL can't express these stages; the tests hold the result against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each stage's rows are written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
            if before is not None:
                discard(before)
            before = docs
    return docs
