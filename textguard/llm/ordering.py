"""Numbers of rows within groups, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textguard.scratch import stage

_PART_BITS = 33


def numbered(rows: DataFrame, group: str, order: list[str], purpose: str) -> DataFrame:
    """``rows`` with ``pos``, the number from 0 of each within its group, nulls first, and ``n``, the group's size.

    Rows are cut into ranges of (group, order), so a group of any size lies in several; each range numbers its rows and
    starts from the counts of the ranges before. Rows alike in all of ``order`` are kept apart by their place in the
    input and may lie in different ranges. ``group`` is not null, and ``rows`` is a written table: it is read twice.
    """
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [group, *order, "_tie"]
    ranged = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    written = stage(ranged.withColumn("_at", F.monotonically_increasing_id()), purpose)
    written = written.withColumn("_part", F.shiftright("_at", _PART_BITS))
    runs = written.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")
    runs = runs.select(group, "_part", shift.alias("_shift"), F.sum("_rows").over(whole).alias("n"))
    placed = written.join(runs, [group, "_part"]).withColumn("pos", F.col("_at") + F.col("_shift"))
    return placed.drop("_at", "_part", "_shift")
