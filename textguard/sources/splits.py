"""Train / val / test tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")


def write_splits(assigned: DataFrame, path: str) -> None:
    """One write for all splits: a folder per value of ``split``."""
    assigned.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(
    spark: SparkSession,
    path: str,
    split: str,
    columns: Sequence[str] | None = None,
    max_rows: int | None = None,
    order_by: str = "row_id",
) -> DataFrame:
    """One split, with all columns or the named ones, optionally only the first rows in row order.

    The split filter prunes folders; the column list reaches the parquet scan.
    """
    rows = spark.read.parquet(path).where(F.col("split") == split).drop("split")
    if max_rows is not None:
        rows = rows.orderBy(order_by).limit(max_rows)
    return rows.select(*columns) if columns else rows
