"""Exact ranks in a reproducible random order, without sorting a whole group in one task.

Rows are ordered by a 32-digit hexadecimal hash (``_order``), so hash prefixes are evenly filled
buckets of that order. Counting prefixes finds the bucket of the k-th row, and only the rows of that
bucket are looked at again. Two levels of three digits leave one row in 16.7 million to rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textguard.functions.text import order_key
from textguard.scratch import small_table

DIGITS = 3
MAX_BROADCAST_ROWS = 100_000
# Rows of one bucket that are simply ranked.
MAX_RANKED_ROWS = 100_000


def prefix_counts(keyed: DataFrame, group: Sequence[str], digits: int = DIGITS) -> DataFrame:
    """Rows per group and hash prefix: (group, prefix, n), at most 4096 rows per group."""
    return keyed.groupBy(*group, F.left("_order", F.lit(digits)).alias("prefix")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _descend(state: DataFrame, counts: DataFrame, on: Sequence[str]) -> DataFrame:
    """Move every cut into the bucket that holds its k-th row; k becomes the rank inside it and n
    the size of the bucket."""
    running = counts.withColumn(
        "upto",
        F.sum("n").over(
            Window.partitionBy(*on).orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
        ),
    )
    k = F.col("k")
    return (
        state.join(running, list(on))
        .where((k <= F.col("upto")) & (k > F.col("upto") - F.col("n")))
        .withColumn("k", k - (F.col("upto") - F.col("n")))
        .drop("upto")
    )


def rank_cutoffs(
    keyed: DataFrame, group: Sequence[str], wanted: DataFrame, counts: DataFrame | None = None
) -> DataFrame:
    """The ``_order`` value of the k-th row of each group.

    ``keyed`` has the group columns and a unique ``_order``; ``wanted`` is (group, cut, k) with k in
    1..group size; ``counts`` may pass in the result of ``prefix_counts``. Returns (group, cut,
    cutoff): exactly k rows of the group have ``_order <= cutoff``.

    Every pass reads (group, _order) only and leaves one row per group and cut. The second level is
    skipped where the buckets of the first are small already.
    """
    group = list(group)
    cuts = [*group, "cut"]
    narrow = keyed.select(*group, "_order")
    if counts is None:
        counts = prefix_counts(narrow, group)
    state, rows = small_table(_descend(wanted.select(*cuts, "k"), counts, group), MAX_BROADCAST_ROWS)

    # The prefix is part of the join key, so a hot group is spread even where the join shuffles.
    inside = narrow.withColumn("prefix", F.left("_order", F.lit(DIGITS))).join(
        state, [*group, "prefix"]
    )
    if rows is None or max((row["n"] for row in rows), default=0) > MAX_RANKED_ROWS:
        finer = prefix_counts(inside, cuts, 2 * DIGITS)
        state, _ = small_table(_descend(state.select(*cuts, "k"), finer, cuts), MAX_BROADCAST_ROWS)
        inside = (
            inside.drop("prefix", "k", "n")
            .withColumn("prefix", F.left("_order", F.lit(2 * DIGITS)))
            .join(state, [*cuts, "prefix"])
        )
    rank = F.row_number().over(Window.partitionBy(*cuts, "prefix").orderBy("_order"))
    kth = inside.withColumn("rank", rank).where(F.col("rank") == F.col("k"))
    return kth.select(*cuts, F.col("_order").alias("cutoff"))


def dense_row_id(df: DataFrame, key: Column, seed: int | str) -> DataFrame:
    """Shuffle rows and number them 0..n-1: the rank of each row's hash among all rows.

    Rows are ranked inside 4096 hash buckets in parallel; the offsets of the buckets are a table of
    at most 4096 rows.
    """
    keyed = df.drop("row_id").withColumn("_order", order_key(key, seed))
    bucketed = keyed.withColumn("prefix", F.left("_order", F.lit(DIGITS)))
    earlier = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = prefix_counts(keyed.select("_order"), []).select(
        "prefix", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")
    )
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy("_order"))
    return (
        bucketed.withColumn("rank", rank)
        .join(F.broadcast(offsets), "prefix")
        .withColumn("row_id", F.col("offset") + F.col("rank") - 1)
        .drop("prefix", "rank", "offset", "_order")
    )
