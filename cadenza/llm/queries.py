"""The registered queries of the subpackage: one thin function for each operator, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import decontaminate, language_id, lm_score, near_dup, pii, quality, secret_scan, sentencepiece_codec, token_count, token_output


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(modulus: int, remainder: int) -> Column:
    """Whether crc32 of doc_id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold(3, 1)
    model = language_id.train(docs, train_on=~held_out & F.col("doc_id").isNotNull())
    out = language_id.identify(docs, model, keep=[held_out.alias("held_out")])
    return out.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.learn(docs))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(7, 2)
    return lm_score.score(table(spark, sf_dir, "documents"), held_out=held_out, learn=~held_out & F.col("doc_id").isNotNull())


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.find(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_output.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_output.read_ids(spark.read.parquet(folder))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_secret_scan, op3_decontaminate, op4_quality_rules, op5_sentencepiece, op6_lm_score, op7_near_dedup, op8_pii, op9_token_count, op10_token_ids)}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {"op8_pii": pii.ORACLE}
