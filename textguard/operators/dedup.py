"""Exact de-duplication that keeps the first row of each text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.functions.text import text_key

# Larger than any row id, so sources do not overlap.
_SOURCE_STEP = 1 << 64


def global_row_id(df: DataFrame) -> DataFrame:
    """Replace (source_priority, row_id) by one ``row_id`` that is unique over all sources and in the same order."""
    step = F.lit(str(_SOURCE_STEP)).cast("decimal(20,0)")
    position = F.col("source_priority").cast("decimal(10,0)") * step + F.col("row_id").cast("decimal(20,0)")
    return df.withColumn("row_id", position).drop("source_priority")


def dedup_exact(df: DataFrame) -> DataFrame:
    """One row per text: the first in (source_priority, row_id) order, whatever the size of the ids.

    One scan and one shuffle on the text's hash. Copies are combined before the shuffle, so a text with very many
    copies costs one row per task.
    """
    row, position = F.struct(*df.columns), F.struct("source_priority", "row_id")
    first = df.groupBy(text_key(F.col("text")).alias("_key")).agg(F.min_by(row, position).alias("_row"))
    return first.select("_row.*")


def dedup_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before, after and removed: in total, per source and per label.

    One row per (scope, value); both inputs collapse to source x label cells first.
    """

    def cells(df: DataFrame, column: str) -> DataFrame:
        return df.groupBy("source_dataset", "label").agg(F.count(F.lit(1)).alias(column))

    both = cells(before, "rows_before").unionByName(cells(after, "rows_after"), allowMissingColumns=True)
    source, label = F.col("source_dataset"), F.col("label").cast("string")
    scopes = F.array(
        F.struct(F.lit("total").alias("scope"), F.lit("all").alias("value")),
        F.struct(F.lit("source").alias("scope"), source.alias("value")),
        F.struct(F.lit("label").alias("scope"), label.alias("value")),
    )
    counted = (
        both.select(F.explode(scopes).alias("s"), "rows_before", "rows_after")
        .groupBy("s.scope", "s.value")
        .agg(
            F.coalesce(F.sum("rows_before"), F.lit(0)).alias("rows_before"),
            F.coalesce(F.sum("rows_after"), F.lit(0)).alias("rows_after"),
        )
    )
    return counted.withColumn("removed", F.col("rows_before") - F.col("rows_after"))
