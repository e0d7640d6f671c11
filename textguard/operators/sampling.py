"""Row limits and reproducible uniform samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions.text import order_key
from textguard.operators.hash_rank import dense_row_id, rank_cutoffs
from textguard.operators.split import SEED


def head(df: DataFrame, n: int, order_by: str = "row_id") -> DataFrame:
    """The first min(n, rows) rows in row order, nulls first; of rows that share an order value, those with the least hash.

    Only order values and hashes are merged; the rows come back by a join on both. Rows alike in both are equal, so one of them
    is repeated as often as it is wanted.
    """
    keyed = df.withColumns({"_key": F.col(order_by), "_row": F.xxhash64(*df.columns)})
    first = keyed.select("_key", "_row").orderBy("_key", "_row").limit(n)
    taken = first.groupBy("_key", "_row").agg(F.count(F.lit(1)).cast("int").alias("_times"))
    same = F.col("k._key").eqNullSafe(F.col("t._key")) & (F.col("k._row") == F.col("t._row"))
    found = keyed.alias("k").join(taken.alias("t"), same).select("k.*", "t._times").dropDuplicates(["_key", "_row"])
    times = F.explode(F.array_repeat(F.lit(0), F.col("_times")))
    return found.withColumn("_copy", times).orderBy("_key").select(*df.columns)


def sample_rows(df: DataFrame, n: int, seed: int = SEED, key: Column | None = None) -> DataFrame:
    """min(n, rows) uniform rows without replacement: the n smallest seeded hashes of a unique key.

    The hash of the last row is found by counting hash prefixes; rows are then filtered where they are.
    """
    key = F.col("row_id") if key is None else key
    keyed = df.withColumn("_order", order_key(key, seed))
    if df.count() <= n:
        return df
    one = keyed.withColumn("_all", F.lit(0))
    wanted = df.sparkSession.createDataFrame([(0, "sample", n)], "_all int, cut string, k bigint")
    cutoff = rank_cutoffs(one, ["_all"], wanted).first()["cutoff"]
    return keyed.where(F.col("_order") <= cutoff).drop("_order")


def shared_eval_sample(
    df: DataFrame,
    full_sources: Sequence[str],
    big_source: str,
    n_big: int = 500,
    seed: int = SEED,
    key: Column | None = None,
) -> DataFrame:
    """All rows of the small sources and ``n_big`` random rows of the big one, shuffled.

    Rows get a dense ``row_id`` from 0. Asking for more rows than the big source has is an error.
    """
    key = F.col("row_id") if key is None else key
    keyed = df.withColumn("_key", key)
    big = keyed.where(F.col("source_dataset") == big_source)
    available = big.count()
    if available < n_big:
        raise ValueError(f"{big_source} has {available} rows, {n_big} wanted")
    picked = sample_rows(big, n_big, seed, F.col("_key"))
    rows = keyed.where(F.col("source_dataset").isin(*full_sources)).unionByName(picked)
    return dense_row_id(rows, F.col("_key"), f"{seed}:shuffle").drop("_key")
