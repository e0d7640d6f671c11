"""Decision threshold sweep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.functions.probability import steps_at_or_below
from textguard.operators.metrics import (
    LABEL,
    PREDICTION,
    PROB,
    SOURCE,
    bin_calibration,
    cell_ranking,
    cells,
    cells_with_bounds,
    confusion_columns,
    finish_scope,
    group_keys,
    rates,
    scope_rows,
    score_bins,
    scored_count,
)

# The swept thresholds.
GRID = (
    0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85,
    0.9, 0.91, 0.92, 0.93, 0.94, 0.95, 0.96, 0.97, 0.98,
    0.99, 0.992, 0.994, 0.996, 0.998,
)


def sweep_counts(
    counted: DataFrame, grid: Sequence[float], by: Sequence[str] = (), source: str | None = SOURCE
) -> DataFrame:
    """Confusion counts per threshold from one pass over counted scores.

    A score only matters by how many thresholds it reaches, so rows collapse to at most
    len(grid) + 1 cells per group and label; each cell then counts once per threshold.
    """
    group = group_keys(by, source)
    reached = (
        scope_rows(counted, by, source, ["score", LABEL, scored_count().alias("n")])
        .groupBy(*group, LABEL, steps_at_or_below(F.col("score"), list(grid)).alias("reached"))
        .agg(F.sum("n").alias("n"))
        .where("n > 0")
    )
    steps = F.array(
        *[
            F.struct(F.lit(float(t)).alias("threshold"), F.lit(i + 1).alias("step"))
            for i, t in enumerate(grid)
        ]
    )
    predicted = (F.col("reached") >= F.col("t.step")).cast("int")
    return (
        reached.withColumn("t", F.explode(steps))
        .groupBy(F.col("t.threshold").alias("threshold"), *group)
        .agg(*confusion_columns(F.col("n"), F.col(LABEL), predicted))
    )


def threshold_sweep(
    scored: DataFrame,
    grid: Sequence[float] = GRID,
    by: Sequence[str] = (),
    source: str | None = SOURCE,
    prob: str = PROB,
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """All metrics per threshold and group, positive where probability >= threshold.

    Metrics that need no threshold are computed once and repeat. The grid must ascend.
    """
    group = group_keys(by, source)
    counted, bounds = cells_with_bounds(cells(scored.drop(PREDICTION), by, source, prob), bounds)
    return finish_scope(
        rates(sweep_counts(counted, grid, by, source))
        .join(cell_ranking(counted, by, source, bounds), group, "left")
        .join(bin_calibration(score_bins(counted, by, source, 10), by, source), group, "left"),
        source,
    )


def best_threshold(
    sweep: DataFrame, metric: str = "f1", source_value: str | None = None, source: str = SOURCE
) -> DataFrame:
    """Per group the sweep row with the largest metric; the lowest threshold wins ties.

    With ``source_value`` only that source; a source the sweep does not have is an error.
    """
    per_source = sweep.where(F.col("scope") == "source")
    best = per_source.groupBy(source).agg(
        F.max_by(F.struct(*sweep.columns), F.struct(F.col(metric), -F.col("threshold"))).alias("best")
    )
    if source_value is None:
        return best.select("best.*")
    chosen = best.where(F.col(source) == source_value)
    found = chosen.agg(F.first("best").alias("best"), F.count(F.lit(1)).alias("n"))
    missing = F.raise_error(F.lit(f"source not in the sweep: {source_value}"))
    return (
        found.withColumn("_ok", F.when(F.col("n") == 0, missing.cast("boolean")).otherwise(True))
        .where("_ok")
        .select("best.*")
    )


def sweep_table(
    sweep: DataFrame, sources: Sequence[str], precision_source: str, source: str = SOURCE
) -> DataFrame:
    """One row per threshold: overall f1, f1 per source, and precision of one source."""
    name = F.when(F.col("scope") == "overall", "overall").otherwise(F.col(source))
    wide = (
        sweep.withColumn("_name", name)
        .groupBy("threshold")
        .pivot("_name", ["overall", *sources])
        .agg(F.first("f1").alias("f1"), F.first("precision").alias("precision"))
    )
    return wide.select(
        "threshold",
        *[F.col(f"{s}_f1").alias(f"f1_{s}") for s in ("overall", *sources)],
        F.col(f"{precision_source}_precision").alias(f"precision_{precision_source}"),
    )


def tune_then_confirm(
    val: DataFrame,
    test: DataFrame,
    source_value: str,
    metric: str = "f1",
    grid: Sequence[float] = GRID,
) -> DataFrame:
    """Choose the threshold on val for one source; report test metrics at that threshold.

    The test sweep already holds every grid threshold, so confirming is an equi-join of two small
    tables.
    """
    chosen = best_threshold(threshold_sweep(val, grid), metric, source_value).select(
        "threshold", F.col(metric).alias(f"val_{metric}")
    )
    return threshold_sweep(test, grid).join(chosen, "threshold")
