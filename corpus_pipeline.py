"""A training corpus in five stages: language ID, exact dedup, near-duplicate removal, mixing to weights, packing.

Each stage takes (spark, docs, sf_dir) and works on everything the stage before kept; ``run`` writes a stage's rows as
Parquet in the shared folder and reads them again for the next. All stages but the last return the columns of their
input; the last returns where each piece of each document lies in the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.llm._shared import Scratch
from foldspark.llm.exact_dedup import drop_duplicates
from foldspark.llm.language_id import UNKNOWN, fit_prototypes, predict_language, split_of
from foldspark.llm.mixing import mixed_rows
from foldspark.llm.near_dedup import near_duplicates
from foldspark.llm.packing import Limits, pack_digest
from foldspark.llm.queries import tokenizer_path

#: The folds of the language model: rows whose crc32 is divisible by it are not learned from.
FOLDS = 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: null text or no letters. Those with one are kept whatever their score.

    Repeated rows stay or go together, columns of any name are kept, an empty table stays empty.
    """
    prototypes = fit_prototypes(docs.filter(~split_of(F.col("doc_id"), FOLDS)))
    plain = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # so no column is called as the prediction is
    text = F.col(plain["text"])
    kept = predict_language(docs.toDF(*plain.values()), prototypes, text=plain["text"])
    kept = kept.filter((F.col("lang_pred") != UNKNOWN) | F.lit(not any(prototypes)) & F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))
    return kept.select(*(F.col(c).alias(name) for name, c in plain.items()))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (A-Z lower-cased) the one with the largest doc_id stays.

    Null text is empty text; a null doc_id stays only where its group has no other; of repeated rows one stays; an empty
    table stays empty.
    """
    return drop_duplicates(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 0.8 or more of their five-word shingles the one with the smallest doc_id stays.

    Rows with a null doc_id or without words stay; rows that share a doc_id go or stay by their own texts. An empty table stays empty.
    """
    gone = near_duplicates(docs, words=5, percent=80, bands=32, rows=4).filter(~F.col("kept")).select("doc_id", "text_hash").distinct()
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.join(gone, (F.col("id") == F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 5, 2, 1 in turn for 150 % of all words; a document the mix takes twice is two rows.

    A null source is the last one; null text has no words; repeated rows share what is taken of them; an empty table
    stays empty.
    """
    return mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens. Null text is its end id alone; no documents give no pieces."""
    return pack_digest(docs, tokenizer_path("word_bpe_49k.json"), 2, Limits())


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]

#: Language vectors, the landing of the mix and the packing heuristic are not SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over all documents; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "corpus-pipeline")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop_all_but(name)  # a stage's input is not read again once its output is written
    return docs
