"""Exact stratified train / val / test split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textguard.functions.text import order_key
from textguard.operators.hash_rank import MAX_BROADCAST_ROWS, prefix_counts, rank_cutoffs
from textguard.scratch import small_table, stage

# Fixed value: the seed used throughout.
SEED = 42


def _proportional(strata: DataFrame, size: str, draws: Column, out: str) -> DataFrame:
    """Largest-remainder share of ``draws`` per stratum; equal remainders go by stratum name.

    One row per stratum: the windows run over that table, not over rows.
    """
    everything = Window.partitionBy()
    share = F.col(size) / F.sum(size).over(everything) * draws
    shared = strata.withColumn("_share", share).withColumn("_floor", F.floor("_share"))
    order = Window.orderBy((F.col("_share") - F.col("_floor")).desc(), "stratum")
    missing = draws - F.sum("_floor").over(everything)
    extra = (F.row_number().over(order) <= missing).cast("bigint")
    return shared.withColumn(out, F.col("_floor") + extra).drop("_share", "_floor")


def split_quotas(strata: DataFrame, val_size: float, test_size: float) -> DataFrame:
    """Rows per stratum for each split from (stratum, n), in two stages.

    First train against the rest, then val against test within the rest; each stage rounds its
    second part up. A stratum with a single row to divide is an error, as is a part with fewer rows
    than strata.
    """
    everything = Window.partitionBy()
    held = val_size + test_size
    total = F.sum("n").over(everything)
    n_temp = F.ceil(total * F.lit(held))
    first = _proportional(strata.withColumn("_train", total - n_temp), "n", F.col("_train"), "n_train")
    first = first.withColumn("n_temp", F.col("n") - F.col("n_train"))

    temp_total = F.sum("n_temp").over(everything)
    n_test = F.ceil(temp_total * F.lit(test_size / held))
    second = _proportional(
        first.withColumn("_val", temp_total - n_test), "n_temp", F.col("_val"), "n_val"
    ).withColumn("n_test", F.col("n_temp") - F.col("n_val"))

    n_strata = F.count(F.lit(1)).over(everything)
    used = F.count_if(F.col("n_temp") > 0).over(everything)
    single = (F.col("n") == 1) | (F.col("n_temp") == 1)
    few = (
        (F.col("_train") < n_strata)
        | (temp_total < n_strata)
        | (F.col("_val") < used)
        | (temp_total - F.col("_val") < used)
    )
    checked = (
        F.when(single, F.raise_error(F.concat(F.lit("stratum too small: "), F.col("stratum"))).cast("bigint"))
        .when(few, F.raise_error(F.lit("fewer rows than strata in a split")).cast("bigint"))
        .otherwise(F.col("n_test"))
    )
    return second.select("stratum", "n", "n_train", "n_val", checked.alias("n_test"))


def stratified_split(
    df: DataFrame,
    val_size: float = 0.1,
    test_size: float = 0.1,
    seed: int = SEED,
    key: Column | None = None,
) -> DataFrame:
    """``df`` with a ``split`` column, stratified on source and label, with exact sizes.

    ``key`` must be unique per row (default ``row_id``); rows of a stratum are taken in the order of
    its seeded hash: test first, then val, the rest is train. Only hash cut-offs are computed, so
    the rows themselves are assigned by a map-side comparison whatever the size of a stratum.
    """
    key = F.col("row_id") if key is None else key
    stratum = F.concat_ws("_", "source_dataset", F.col("label").cast("string"))
    keyed = df.withColumn("stratum", stratum).withColumn("_order", order_key(key, seed))

    counts = stage(prefix_counts(keyed, ["stratum"]), "split-counts")
    quotas = split_quotas(counts.groupBy("stratum").agg(F.sum("n").alias("n")), val_size, test_size)
    cuts = quotas.select(
        "stratum",
        F.explode(
            F.array(
                F.struct(F.lit("test").alias("cut"), F.col("n_test").alias("k")),
                F.struct(F.lit("held").alias("cut"), (F.col("n_test") + F.col("n_val")).alias("k")),
            )
        ).alias("c"),
    ).select("stratum", "c.cut", "c.k")
    cutoffs = rank_cutoffs(keyed, ["stratum"], cuts.where("k > 0"), counts)
    wide, _ = small_table(
        cutoffs.groupBy("stratum").pivot("cut", ["test", "held"]).agg(F.first("cutoff")),
        MAX_BROADCAST_ROWS,
    )
    split = (
        F.when(F.col("_order") <= F.col("test"), "test")
        .when(F.col("_order") <= F.col("held"), "val")
        .otherwise("train")
    )
    return (
        keyed.join(wide, "stratum", "left")
        .withColumn("split", split)
        .drop("stratum", "_order", "test", "held")
    )
