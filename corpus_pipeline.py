"""The corpus pipeline: five stages, each reading the Parquet that the one before has written.

Language ID, line dedup, near-dedup, mixing and SentencePiece encoding.  ``run`` applies them to ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrubric.llm import language, lines, mixing, pieces, similar, simhash
from sparkrubric.llm.storage import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text with letters stays if its best language is at least this near; no language at all is a rejection.
LEAST_COSINE = 0.05


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or unlike every language; ``lang`` becomes the predicted one."""
    prototypes = language.train(docs, F.col("lang"))
    found = language.predict(docs, prototypes)
    stays = (F.col("lang_pred") != language.UNKNOWN) & (F.col("cosine") >= LEAST_COSINE)
    return found.where(stays).withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines of recurring templates, and documents that lose their last word by that."""
    kept = lines.drop_templates(docs)
    left = (F.col("n_dropped") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    return kept.where(F.coalesce(left, F.lit(True))).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies: five-word Jaccard of 0.8 or more."""
    return simhash.first_of_each(docs, similar.near_copies(docs)).select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents to the target weights, in one global random order."""
    return mixing.mix(docs).select(COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    return pieces.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing_stage),
    ("encoding", encoding),
]

#: Hyperdimensional profiles, linked near copies and piece encoding are out of SQL's reach; the tests hold the
#: pipeline against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
