"""First look at a raw dataset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Label column names looked for, in this order.
LABEL_COLUMNS = ("label", "labels", "category", "class")


@dataclass(frozen=True)
class Profile:
    columns: list[str]
    label_column: str | None
    shape: DataFrame
    label_counts: DataFrame | None
    head: DataFrame


def profile(df: DataFrame, order_by: str | None = None, head_rows: int = 5) -> Profile:
    """Shape, columns, counts of the first label column present, and the first rows."""
    label = next((c for c in LABEL_COLUMNS if c in df.columns), None)
    shape = df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns))
    )
    counts = None
    if label is not None:
        counts = df.groupBy(F.col(label).cast("string").alias("value")).agg(
            F.count(F.lit(1)).alias("n")
        )
    ordered = df.orderBy(order_by) if order_by else df
    return Profile(df.columns, label, shape, counts, ordered.limit(head_rows))
