"""A training corpus from raw documents, in stages that each work on what the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicsift.llm import bpe, exact_dedup, mixing, quality, simhash
from civicsift.llm.common import small_batches, unpacked, whole_row
from civicsift.llm.queries import QUALITY_THRESHOLD, quality_model, table, vocabulary_path
from civicsift.session import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier does not reject."""
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    scored = docs.select(whole_row(docs).alias("row"), quality.score(docs["text"], model).alias("score"))
    kept = scored.filter(F.col("score") >= QUALITY_THRESHOLD)
    return kept.select(*unpacked(kept, docs.columns))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicate(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of close fingerprints."""
    small_batches(spark)
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix of its source takes it."""
    return mixing.repeat_rows(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, and whether they decode to its text."""
    small_batches(spark)
    vocabulary = bpe.load_vocabulary(vocabulary_path())
    coded = docs.select("doc_id", "lang", "source", "text", bpe.round_trip(F.col("text"), vocabulary).alias("coded"))
    return coded.select("doc_id", "lang", "source", F.size("coded.ids").cast("long").alias("n_tokens"),
                        F.col("coded.ids").alias("ids"),
                        (F.col("coded.text") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", good_quality),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("mixing", mixed),
    ("bpe", tokenised),
]

ORACLE_SQL = None  # a trained classifier, random rounding and a vocabulary file are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
