"""Metric reports as JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report_json(df: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """One JSON document per report row, without the named columns (long lists in a summary)."""
    kept = [c for c in df.columns if c not in set(drop)]
    return df.select(F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}).alias("report"))


def write_report(df: DataFrame, path: str, drop: Sequence[str] = ()) -> None:
    report_json(df, drop).write.mode("overwrite").text(path)
