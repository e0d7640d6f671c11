"""Descriptive tables over splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_profile(df: DataFrame) -> DataFrame:
    """Per split: rows, attack share and text length mean / median / min / max.

    The exact median counts rows per distinct length, of which there are no more than the longest
    text has characters.
    """
    length = F.length("text").cast("bigint")
    return (
        df.select("split", "label", length.alias("n_chars"))
        .groupBy("split")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.avg("label").alias("attack_share"),
            F.avg("n_chars").alias("mean_chars"),
            F.percentile("n_chars", F.lit(0.5)).alias("median_chars"),
            F.min("n_chars").alias("min_chars"),
            F.max("n_chars").alias("max_chars"),
        )
    )


def split_balance(df: DataFrame) -> DataFrame:
    """Rows and label proportion per source within each split. Only cell counts reach the window."""
    cells = df.groupBy("split", "source_dataset", "label").agg(F.count(F.lit(1)).alias("n"))
    per_source = cells.groupBy("split", "source_dataset").agg(F.sum("n").alias("n_source"))
    return cells.join(per_source, ["split", "source_dataset"]).select(
        "split",
        "source_dataset",
        "label",
        "n",
        (F.col("n") / F.col("n_source")).alias("proportion"),
    )
