"""Binary classification metrics over a scored table.

A scored table has ``label`` (0/1), ``prediction`` (0/1) and, where there is one, ``prob_positive``.
Rows first collapse to counted cells (group, label, prediction, score); every metric is computed from
those cells. ``by`` names extra grouping columns; ``source`` names the column for which an overall
row and one row per value come out together (``scope`` is 'overall' or 'source').
Group columns must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions.probability import probability_bin
from textguard.operators.ranges import percentiles, running_totals, value_bounds
from textguard.scratch import stage

LABEL, PREDICTION, PROB, SOURCE = "label", "prediction", "prob_positive", "source_dataset"
# Smallest likelihood in the loss, and the rows timed for latency.
LOSS_FLOOR = 1e-12
LATENCY_ROWS = 200
# Size of a latency sketch: ranks within some 0.2 % of all measurements.
SKETCH_K = 800


def rate_or_zero(numerator: Column, denominator: Column) -> Column:
    """Ratio in DOUBLE; 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def cells(
    scored: DataFrame, by: Sequence[str] = (), source: str | None = SOURCE, prob: str | None = PROB
) -> DataFrame:
    """Counted cells of a scored table: the only pass over its rows, with map-side combination.

    Metrics that need a score count rows without one as zero instead of filtering on it: a filter
    would move below this aggregate, and the metrics could no longer share its shuffle.
    """
    keys = [*by, *([source] if source else [])]
    prediction = F.col(PREDICTION) if PREDICTION in scored.columns else F.lit(None).cast("int")
    score = F.col(prob).cast("double") if prob else F.lit(None).cast("double")
    return (
        scored.select(*keys, LABEL, prediction.alias(PREDICTION), score.alias("score"))
        .groupBy(*keys, LABEL, PREDICTION, "score")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def cells_with_bounds(
    counted: DataFrame, bounds: Sequence[float] | None
) -> tuple[DataFrame, Sequence[float]]:
    """The cells, and bounds that divide them into ranges of about equal numbers of cells.

    Without given bounds the cells are written once and the bounds come from what was written, so
    the scored rows, and a model that makes their scores, run a single time.
    """
    if bounds is not None:
        return counted, bounds
    counted = stage(counted, "cells")
    return counted, value_bounds(counted, "score")


def scored_count() -> Column:
    """Rows of a cell, 0 where it has no score."""
    return F.when(F.col("score").isNotNull(), F.col("n")).otherwise(F.lit(0))


def scope_rows(
    counted: DataFrame, by: Sequence[str], source: str | None, columns: Sequence[Column | str]
) -> DataFrame:
    """Every row once for its source and once for all sources together, with ``scope``.

    In overall rows the source is '' here and becomes null in results.
    """
    if source is None:
        return counted.select(*by, F.lit("overall").alias("scope"), *columns)
    levels = F.array(
        F.struct(F.lit("overall").alias("scope"), F.lit("").alias(source)),
        F.struct(F.lit("source").alias("scope"), F.col(source).alias(source)),
    )
    return counted.select(*by, F.inline(levels).alias("scope", source), *columns)


def group_keys(by: Sequence[str], source: str | None) -> list[str]:
    return [*by, "scope", *([source] if source else [])]


def finish_scope(df: DataFrame, source: str | None) -> DataFrame:
    if source is None:
        return df
    return df.withColumn(source, F.when(F.col("scope") == "source", F.col(source)))


def confusion_columns(n: Column, label: Column, prediction: Column) -> list[Column]:
    """Aggregates tp, tn, fp, fn and n over counted rows."""

    def total(condition: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0)).alias(name)

    return [
        total((label == 1) & (prediction == 1), "tp"),
        total((label == 0) & (prediction == 0), "tn"),
        total((label == 0) & (prediction == 1), "fp"),
        total((label == 1) & (prediction == 0), "fn"),
        F.sum(n).alias("n"),
    ]


def rates(counts: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1 and mcc from tp, tn, fp, fn, n; empty denominators give 0."""
    tp, tn, fp, fn, n = (F.col(c) for c in ("tp", "tn", "fp", "fn", "n"))
    # Margins multiply in DOUBLE: their product leaves BIGINT long before the counts do.
    margins = [(a + b).cast("double") for a, b in ((tp, fp), (tp, fn), (tn, fp), (tn, fn))]
    product = margins[0] * margins[1] * margins[2] * margins[3]
    tp_, tn_, fp_, fn_ = (c.cast("double") for c in (tp, tn, fp, fn))
    return counts.select(
        "*",
        rate_or_zero(tp + tn, n).alias("accuracy"),
        rate_or_zero(tp, tp + fp).alias("precision"),
        rate_or_zero(tp, tp + fn).alias("recall"),
        rate_or_zero(2 * tp, 2 * tp + fp + fn).alias("f1"),
        rate_or_zero(tp_ * tn_ - fp_ * fn_, F.sqrt(product)).alias("mcc"),
    )


def cell_confusion(counted: DataFrame, by: Sequence[str], source: str | None) -> DataFrame:
    return (
        scope_rows(counted, by, source, [LABEL, PREDICTION, "n"])
        .groupBy(*group_keys(by, source))
        .agg(*confusion_columns(F.col("n"), F.col(LABEL), F.col(PREDICTION)))
    )


def confusion(scored: DataFrame, by: Sequence[str] = (), source: str | None = SOURCE) -> DataFrame:
    """tp, tn, fp, fn, n per group."""
    return finish_scope(cell_confusion(cells(scored, by, source, None), by, source), source)


def classification_rates(
    scored: DataFrame, by: Sequence[str] = (), source: str | None = SOURCE
) -> DataFrame:
    """Confusion counts with accuracy, precision, recall, f1 and mcc."""
    return rates(confusion(scored, by, source))


def _both_classes(positives: Column, negatives: Column, value: Column) -> Column:
    return F.when((positives > 0) & (negatives > 0), value)


def cell_ranking(
    counted: DataFrame, by: Sequence[str], source: str | None, bounds: Sequence[float]
) -> DataFrame:
    """roc_auc and pr_auc per group from running class totals by falling score."""
    group = group_keys(by, source)
    per_score = (
        scope_rows(counted, by, source, [LABEL, "score", scored_count().alias("n")])
        .groupBy(*group, "score")
        .agg(
            F.sum(F.when(F.col(LABEL) == 1, F.col("n")).otherwise(0)).alias("pos"),
            F.sum(F.when(F.col(LABEL) == 0, F.col("n")).otherwise(0)).alias("neg"),
        )
    )
    ranked = running_totals(per_score, group, "score", ["pos", "neg"], bounds, descending=True)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    tp, fp = F.col("upto_pos").cast("double"), F.col("upto_neg").cast("double")
    return (
        ranked.groupBy(*group)
        .agg(
            F.sum(neg * (tp - pos / 2)).alias("_area"),
            F.sum(F.try_divide(pos * tp, tp + fp)).alias("_steps"),
            F.sum("pos").alias("_p"),
            F.sum("neg").alias("_n"),
        )
        .select(
            *group,
            _both_classes(
                F.col("_p"),
                F.col("_n"),
                F.try_divide(F.col("_area"), F.col("_p").cast("double") * F.col("_n")),
            ).alias("roc_auc"),
            _both_classes(
                F.col("_p"), F.col("_n"), F.try_divide(F.col("_steps"), F.col("_p").cast("double"))
            ).alias("pr_auc"),
        )
    )


def score_bins(counted: DataFrame, by: Sequence[str], source: str | None, n_bins: int) -> DataFrame:
    """Per group and probability bin: rows, positives, and the sums the calibration metrics need."""
    p, y, n = F.col("score"), F.col(LABEL), F.col("n")
    likelihood = F.least(F.greatest(p * y + (1 - p) * (1 - y), F.lit(LOSS_FLOOR)), F.lit(1.0))
    rows = scope_rows(counted, by, source, ["score", LABEL, scored_count().alias("n")])
    binned = rows.groupBy(*group_keys(by, source), probability_bin(p, n_bins).alias("bin")).agg(
        F.sum(n).alias("n"),
        F.sum(n * y).alias("positives"),
        F.sum(n * p).alias("sum_prob"),
        F.sum(n * (p - y) * (p - y)).alias("sum_square"),
        F.sum(n * -F.log(likelihood)).alias("sum_loss"),
    )
    return binned.where("n > 0")


def bin_calibration(binned: DataFrame, by: Sequence[str], source: str | None) -> DataFrame:
    """brier_score, ece and log_loss per group from its bins."""
    n, positives = F.sum("n"), F.sum("positives")
    gap = F.sum(F.abs(F.col("sum_prob") - F.col("positives")))
    return binned.groupBy(*group_keys(by, source)).agg(
        _both_classes(positives, n - positives, F.sum("sum_square") / n).alias("brier_score"),
        _both_classes(positives, n - positives, gap / n).alias("ece"),
        (F.sum("sum_loss") / n).alias("log_loss"),
    )


def reliability_bins(
    scored: DataFrame,
    by: Sequence[str] = (),
    source: str | None = SOURCE,
    prob: str = PROB,
    n_bins: int = 10,
) -> DataFrame:
    """Non-empty calibration bins: rows, mean probability, share of positives, absolute gap."""
    binned = score_bins(cells(scored, by, source, prob), by, source, n_bins)
    confidence, share = F.col("sum_prob") / F.col("n"), F.col("positives") / F.col("n")
    return finish_scope(
        binned.select(
            *group_keys(by, source),
            "bin",
            "n",
            confidence.alias("mean_prob"),
            share.alias("positive_share"),
            F.abs(confidence - share).alias("gap"),
        ),
        source,
    )


def ranking_metrics(
    scored: DataFrame,
    by: Sequence[str] = (),
    source: str | None = SOURCE,
    prob: str = PROB,
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """roc_auc (ties count half) and pr_auc (step sum); null for a group with one class.

    ``bounds`` are score range bounds; they set the parallelism, not the result.
    """
    counted, bounds = cells_with_bounds(cells(scored, by, source, prob), bounds)
    return finish_scope(cell_ranking(counted, by, source, bounds), source)


def calibration_metrics(
    scored: DataFrame,
    by: Sequence[str] = (),
    source: str | None = SOURCE,
    prob: str = PROB,
    n_bins: int = 10,
) -> DataFrame:
    """brier_score and ece (null for a group with one class), and log_loss."""
    binned = score_bins(cells(scored, by, source, prob), by, source, n_bins)
    return finish_scope(bin_calibration(binned, by, source), source)


def binary_metrics(
    scored: DataFrame,
    by: Sequence[str] = (),
    source: str | None = SOURCE,
    prob: str | None = PROB,
    n_bins: int = 10,
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """All metrics, one row per group. Without a probability the last five are null.

    Groups whose rows carry no probability get nulls too, so judges with and without one can share
    a table.
    """
    group = group_keys(by, source)
    if prob is None:
        hard = rates(cell_confusion(cells(scored, by, source, None), by, source))
        empty = F.lit(None).cast("double")
        names = ("roc_auc", "pr_auc", "brier_score", "ece", "log_loss")
        return finish_scope(hard.withColumns({c: empty for c in names}), source)
    counted, bounds = cells_with_bounds(cells(scored, by, source, prob), bounds)
    return finish_scope(
        rates(cell_confusion(counted, by, source))
        .join(cell_ranking(counted, by, source, bounds), group, "left")
        .join(bin_calibration(score_bins(counted, by, source, n_bins), by, source), group, "left"),
        source,
    )


def latency_summary(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    n_rows: int | None = None,
    order_by: str = "row_id",
) -> DataFrame:
    """mean, p50, p95, p99 (linear interpolation) and the number of measurements.

    ``n_rows`` keeps the first rows only, as a request-at-a-time measurement of a split does.
    """
    rows = df if n_rows is None else df.orderBy(order_by).limit(n_rows)
    rows = rows.where(F.col(value).isNotNull())
    points = percentiles(rows, by, value, {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99})
    means = rows.groupBy(*by).agg(
        F.avg(value).alias("mean_ms"), F.count(F.lit(1)).alias("n_samples")
    )
    if by:
        return means.join(points, list(by))
    one = F.lit(0)
    return means.withColumn("_one", one).join(points.withColumn("_one", one), "_one").drop("_one")


def latency_sketch(df: DataFrame, value: str, by: Sequence[str] = (), k: int = SKETCH_K) -> DataFrame:
    """Per group a KLL sketch of the measurements, their number and sum: a row of bounded size that later ones merge with.

    Ranks of a sketch are off by about 1.65 / k of all measurements (with 99 % confidence). Nulls are left out.
    """
    rows = df.where(F.col(value).isNotNull())
    return rows.groupBy(*by).agg(
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"),
        F.count(F.lit(1)).alias("n_samples"),
        F.sum(F.col(value).cast("double")).alias("total_ms"),
    )


def merge_sketches(sketches: DataFrame, by: Sequence[str] = (), k: int = SKETCH_K) -> DataFrame:
    """The sketches of ``latency_sketch``, of any runs, as one per group."""
    return sketches.groupBy(*by).agg(
        F.kll_merge_agg_double("sketch", k).alias("sketch"), F.sum("n_samples").alias("n_samples"), F.sum("total_ms").alias("total_ms")
    )


def sketched_latency(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``latency_summary`` from sketches; percentiles are measured values near the exact ones in rank."""
    points = {f"p{round(q * 100)}_ms": F.kll_sketch_get_quantile_double("sketch", F.lit(q)) for q in (0.5, 0.95, 0.99)}
    mean = F.try_divide(F.col("total_ms"), F.col("n_samples"))
    return sketches.select(*by, mean.alias("mean_ms"), "n_samples", *(c.alias(n) for n, c in points.items()))


def evaluate(
    scored: DataFrame,
    latency: DataFrame | None = None,
    by: Sequence[str] = (),
    source: str = SOURCE,
    prob: str = PROB,
) -> DataFrame:
    """The evaluation report: metrics overall and per source, with the loss and the latency summary
    (columns of ``latency_summary``) on the overall row."""
    overall = F.col("scope") == "overall"
    report = (
        binary_metrics(scored, by, source, prob)
        .withColumn("eval_loss", F.when(overall, F.col("log_loss")))
        .drop("log_loss")
    )
    if latency is None:
        return report
    return report.join(latency.withColumn("scope", F.lit("overall")), "scope", "left")
