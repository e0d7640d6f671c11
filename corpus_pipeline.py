"""Documents to packed training sequences: five stages, each written before the next one reads it.

The stages take tables of documents with any further columns, and all but the last keep them. An empty table passes through.
Texts are read whole, of any length.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textguard.llm.decontamination import decontaminated
from textguard.llm.exact_dedup import drop_duplicates
from textguard.llm.ngram_join import keep_one_of_each
from textguard.llm.packing import pack_documents
from textguard.llm.toxicity import fit_toxicity, without_toxic
from textguard.scratch import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; null and empty texts score like any text without signals, repeated rows alike."""
    return without_toxic(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id; null and empty texts are equal, of rows that repeat id and text one stays."""
    return drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their shingles, that with the smallest id; those without words or an id stay, rows that share the
    smallest id all stay."""
    return keep_one_of_each(docs)


def reject_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark; those without words stay, an empty benchmark rejects none."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences; a null or empty text is one piece, pieces of a length are interchangeable."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", reject_leaks),
    ("best_fit_packing", pack),
]

#: Scores and token ids have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
