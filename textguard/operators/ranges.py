"""Running totals over all rows of a group in value order, computed in parallel value ranges.

A window ordered over a whole group is one task. Here the values are cut into ranges of about equal
row counts; each range sums up on its own and starts from the total of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_RANGES = 4096


def value_bounds(df: DataFrame, value: str, n_ranges: int | None = None) -> list[float]:
    """Ascending inner bounds of value ranges: one pass over one column, at most 4095 numbers."""
    if n_ranges is None:
        n_ranges = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_ranges = max(2, min(MAX_RANGES, n_ranges))
    points = [i / n_ranges for i in range(1, n_ranges)]
    array = F.expr("array(" + ",".join(f"{p!r}D" for p in points) + ")")
    row = df.agg(F.percentile_approx(F.col(value).cast("double"), array, 10 * n_ranges)).first()
    return sorted(set(row[0] or []))


def with_range(df: DataFrame, value: str, bounds: Sequence[float], name: str) -> DataFrame:
    """Add how many of the ascending bounds are <= value, by binary search.

    One projection per step: each reads the result of the step before it, so all of them compile
    into one loop body. The bounds are padded to a power of two with infinity.
    """
    steps = len(bounds).bit_length()
    if not steps:
        return df.withColumn(name, F.lit(0))
    padded = [*(f"double('{b!r}')" for b in bounds)] + ["double('Infinity')"] * ((1 << steps) - 1 - len(bounds))
    edges = F.expr(f"array({','.join(padded)})")
    df = df.withColumn(name, F.lit(0))
    for step in (1 << i for i in reversed(range(steps))):
        reached = F.coalesce(F.get(edges, F.col(name) + step - 1) <= F.col(value), F.lit(False))
        df = df.withColumn(name, F.col(name) + F.when(reached, F.lit(step)).otherwise(F.lit(0)))
    return df


def running_totals(
    cells: DataFrame,
    group: Sequence[str],
    value: str,
    measures: Sequence[str],
    bounds: Sequence[float],
    descending: bool = False,
) -> DataFrame:
    """Per row of ``cells``: ``upto_<measure>``, the sum over the rows of the group up to and
    including this value, and ``all_<measure>``, the sum over the whole group.

    ``cells`` has one row per group and value; group columns must not be null. The total before a
    range enters it as a row ahead of all others, so one shuffle and one sort do.
    """
    keys = [*group, "_range"]
    ranged = with_range(cells.select(*group, value, *measures), value, bounds, "_range")
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    ahead = (
        Window.partitionBy(*group)
        .orderBy(direction("_range"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = ranged.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])
    heads = totals.select(
        *keys,
        F.lit(None).cast(cells.schema[value].dataType).alias(value),
        *[F.coalesce(F.sum(m).over(ahead), F.lit(0)).alias(m) for m in measures],
        *[F.sum(m).over(Window.partitionBy(*group)).alias(f"_all_{m}") for m in measures],
        F.lit(0).alias("_order"),
    )
    rows = ranged.select(
        *keys,
        value,
        *measures,
        *[F.lit(0).cast("bigint").alias(f"_all_{m}") for m in measures],
        F.lit(1).alias("_order"),
    )
    inside = (
        Window.partitionBy(*keys)
        .orderBy("_order", direction(value))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        rows.unionByName(heads)
        .select(
            *group,
            value,
            *measures,
            "_order",
            *[F.sum(m).over(inside).alias(f"upto_{m}") for m in measures],
            *[F.sum(f"_all_{m}").over(inside).alias(f"all_{m}") for m in measures],
        )
        .where("_order = 1")
        .drop("_order")
    )


def percentiles(
    df: DataFrame, group: Sequence[str], value: str, points: dict[str, float]
) -> DataFrame:
    """Exact percentiles with linear interpolation, one column per entry of ``points``.

    Counts per distinct value are ranked in parallel ranges, so no task holds the values of a group.
    """
    keys = list(group) or ["_all"]
    given = df.where(F.col(value).isNotNull())
    if not group:
        given = given.withColumn("_all", F.lit(0))
    given = given.select(*keys, F.col(value).cast("double").alias("_v"))
    cells = given.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(cells, keys, "_v", ["n"], value_bounds(given, "_v"))
    last, first = F.col("upto_n") - 1, F.col("upto_n") - F.col("n")
    columns = []
    for name, point in points.items():
        at = (F.col("all_n") - 1) * F.lit(point)
        low, high = F.floor(at), F.ceil(at)
        columns += [
            F.max(F.when(low.between(first, last), F.col("_v"))).alias(f"_lo_{name}"),
            F.max(F.when(high.between(first, last), F.col("_v"))).alias(f"_hi_{name}"),
            F.max(at - low).alias(f"_w_{name}"),
        ]
    found = ranked.groupBy(*keys).agg(*columns)
    return found.select(
        *group,
        *[
            (
                F.col(f"_lo_{name}")
                + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_w_{name}")
            ).alias(name)
            for name in points
        ],
    )
