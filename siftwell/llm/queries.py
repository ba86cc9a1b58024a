"""The registered queries of the training-data operators, with production parameters, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from siftwell.llm import oracles
from siftwell.llm.byte_bpe import bpe_digest
from siftwell.llm.chat_formatting import chat_digest
from siftwell.llm.common import table
from siftwell.llm.decontamination import benchmark_hits
from siftwell.llm.embedding_near_dedup import near_duplicate_embeddings
from siftwell.llm.hard_negatives import hard_negatives
from siftwell.llm.importance_resampling import resample
from siftwell.llm.language_id import identify_documents, identify_pages
from siftwell.llm.license_scan import duckdb_sql, license_digest
from siftwell.llm.line_dedup import line_digest
from siftwell.llm.ngram_jaccard_join import similar_groups
from siftwell.llm.pii import pii_digest
from siftwell.llm.sharding import assign_shards, tree
from siftwell.llm.token_output import token_digest


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(table(spark, sf_dir, "documents"))


def language_id_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_embeddings(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat_digest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "item_id", "start", "similarity")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), tree(16), tree(17))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"), size=3, num=90, den=100)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, least_words=20)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(table(spark, sf_dir, "documents"), least_chars=10)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)").alias("label"))
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_byte_bpe, op2_language_id, language_id_of_pages, op3_license_scan, op4_embedding_near_dedup, op5_chat_formatting, op6_decontamination, op7_sharding, op8_pii, op9_ngram_jaccard_join, op10_token_output, op11_importance_resampling, op12_line_dedup, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scan": duckdb_sql(), "op4_embedding_near_dedup": oracles.OP4, "op5_chat_formatting": oracles.OP5, "op9_ngram_jaccard_join": oracles.OP9, "op12_line_dedup": oracles.OP12, "op13_hard_negatives": oracles.OP13}
