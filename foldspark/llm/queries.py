"""The operators of this subpackage as queries over the test tables, each over its whole table.

``QUERIES`` maps a name to a function of (spark, sf_dir); ``ORACLE_SQL`` holds DuckDB SQL for the same rows where SQL
can express them.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_rotation, exact_dedup, exact_topk, exponion, hard_negatives
from .bpe_automaton import bpe_digest
from .class_lm import class_scores
from .exact_dedup import mark_duplicates
from .language_id import language_id, split_of
from .mixing import balanced_mix
from .near_dedup import near_duplicates
from .packing import Limits, pack_digest
from .token_binary import token_binary
from .token_counts import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    """A public tokenizer file; the folder can be set by FOLDSPARK_TOKENIZERS."""
    if folder := os.environ.get("FOLDSPARK_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_mix(table(spark, sf_dir, "documents"))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL["op3_exact_dedup"] = exact_dedup.ORACLE_SQL


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_digest(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 2, Limits(segments=64))


@query
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


@query
def op7_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_rotation.rotate(table(spark, sf_dir, "conversations"))


ORACLE_SQL["op7_chat_rotation"] = chat_rotation.ORACLE_SQL


@query
def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 0)


@query
def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return class_scores(docs.select("doc_id", split_of(F.col("doc_id"), 10).alias("held_out"), "text"))


@query
def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.exact_topk(table(spark, sf_dir, "embeddings"))


ORACLE_SQL["op10_exact_topk"] = exact_topk.ORACLE_SQL


@query
def op11_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query
def op12_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion.cluster_digest(exponion.exponion(table(spark, sf_dir, "embeddings")))


ORACLE_SQL["op12_exponion"] = exponion.ORACLE_SQL


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return hard_negatives.hard_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


ORACLE_SQL["op13_hard_negatives"] = hard_negatives.ORACLE_SQL
