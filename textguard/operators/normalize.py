"""Differently shaped raw tables → one (row_id, text, label, source_dataset, category) table."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions.text import strip

# The positive raw label, and the prompt types in scope.
POSITIVE_LABEL = "jailbreak"
SCOPED_TYPES = ("prompt_injection", "jailbreak")

Normalizer = Callable[[DataFrame], DataFrame]


def _row_id(df: DataFrame) -> Column:
    """The given row order, or one from the file order where the table has none."""
    return F.col("row_id").cast("bigint") if "row_id" in df.columns else F.monotonically_increasing_id()


def _required_int(value: Column, name: str) -> Column:
    number = value.cast("int")
    return F.when(number.isNull(), F.raise_error(F.lit(f"{name} is not an integer")).cast("int")).otherwise(
        number
    )


def normalize_text_label(df: DataFrame, source: str) -> DataFrame:
    """String label: 1 only for the exact positive label; null and anything else give 0."""
    return df.select(
        _row_id(df).alias("row_id"),
        "text",
        F.coalesce(F.col("label") == POSITIVE_LABEL, F.lit(False)).cast("int").alias("label"),
        F.lit(source).alias("source_dataset"),
        F.col("label").alias("category"),
    )


def normalize_int_label(df: DataFrame, source: str) -> DataFrame:
    """Integer label, category kept. A label that is no integer is an error."""
    return df.select(
        _row_id(df).alias("row_id"),
        "text",
        _required_int(F.col("label"), "label").alias("label"),
        F.lit(source).alias("source_dataset"),
        "category",
    )


def normalize_scoped(df: DataFrame, source: str, types: tuple[str, ...] = SCOPED_TYPES) -> DataFrame:
    """Rows of the prompt types in scope, renamed. The type filter reaches the scan."""
    scoped = df.where(F.col("prompt_type").isin(*types))
    return scoped.select(
        _row_id(df).alias("row_id"),
        F.col("prompt").alias("text"),
        _required_int(F.col("prompt_adversarial"), "prompt_adversarial").alias("label"),
        F.lit(source).alias("source_dataset"),
        F.col("prompt_type").alias("category"),
    )


def union_sources(frames: Mapping[str, DataFrame], registry: Mapping[str, Normalizer]) -> DataFrame:
    """Normalize each frame by name and stack them; ``source_priority`` is the registry position."""
    unknown = set(frames) - set(registry)
    if unknown:
        raise KeyError(f"no normalizer for {sorted(unknown)}")
    parts = [
        registry[name](frames[name]).withColumn("source_priority", F.lit(priority))
        for priority, name in enumerate(registry)
        if name in frames
    ]
    return reduce(DataFrame.unionByName, parts)


def strip_and_drop_empty(df: DataFrame) -> DataFrame:
    """Strip Unicode whitespace; rows with no text left, or none at all, go."""
    return df.withColumn("text", strip(F.col("text"))).where(F.col("text") != "")


def filter_source(df: DataFrame, source: str) -> DataFrame:
    return df.where(F.col("source_dataset") == source)
