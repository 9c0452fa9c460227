"""The corpus pipeline: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's ``docs``. All but the last return the columns of ``documents``. Empty tables pass through.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import byte_bpe, decontamination, language_crf, line_dedup, near_copies
from marginalia.llm.arrow import stored
from marginalia.llm.queries import BYTE_RANKS

#: A document in no language, or in none to this share of its words, is rejected.
LEAST_LANGUAGE = 0.4


def _documents(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language; fills in a missing ``lang``.

    A null text has no language and goes; repeated rows are judged one by one.
    """
    model = language_crf.train(*language_crf.sample(docs.filter(language_crf.fold(5) != 0)))
    judged = language_crf.predicted(docs, model, keep=("text", "lang", "source"))
    kept = judged.filter((F.col("lang_pred") != language_crf.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE))
    return _documents(kept.withColumn("lang", F.coalesce("lang", "lang_pred")))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that a document before this one holds; documents stay, whatever is left of them."""
    return _documents(line_dedup.deduplicated(docs, keep=("lang", "source")).withColumnRenamed("kept", "text"))


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies stays: the one with the smallest id.

    Rows are told apart by id and content, so those that share an id, or have none, are judged by their texts.
    """
    return _documents(near_copies.kept(docs.select("doc_id", "text", "lang", "source")))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, with or without an id; rows of one id are judged by their texts."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    found = decontamination.contaminated(keyed.select(F.col("text_key").alias("doc_id"), "text"), benchmark)
    found = stored(found.select(F.col("doc_id").alias("text_key")).distinct(), "contaminated")
    return _documents(keyed.join(found, "text_key", "left_anti"))


def byte_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, and the hash of the bytes they decode to."""
    found = byte_bpe.encoded(docs, public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)
    size = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return found.select("doc_id", size, "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("decontamination", benchmark_decontamination),
    ("byte_bpe", byte_tokens),
]

#: SQL cannot express the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
