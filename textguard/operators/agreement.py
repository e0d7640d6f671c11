"""Comparing several judges of the same rows.

A judge is named by a ``Judge``: its prediction column (0/1, null where it refused) in the aligned
table and, where it has one, its probability column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions.text import encode_label, preview
from textguard.operators.metrics import LABEL, SOURCE, binary_metrics
from textguard.sources.results import resolve_results

# Fixed value: code points shown of a text two judges disagree on.
PREVIEW_CHARS = 200


class Judge(NamedTuple):
    name: str
    prediction: str
    prob: str | None = None


def align(sample: DataFrame, results: Mapping[str, DataFrame], on: str = "row_id") -> DataFrame:
    """Attach each judge's columns to the sample by row id, prefixed with the judge's name.

    A log of any kind may have several records for a row; each row gets one (see ``resolve_results``), an answer or a
    refusal before an error. ``<name>_present`` tells a row without any record from a refusal.
    """
    for name, result in results.items():
        result = resolve_results(result, on).withColumn("present", F.lit(True))
        renamed = result.select(
            on, *[F.col(c).alias(f"{name}_{c}") for c in result.columns if c != on]
        )
        sample = sample.join(renamed, on, "left")
    return sample


def completeness(sample: DataFrame, results: Mapping[str, DataFrame], on: str = "row_id") -> DataFrame:
    """Per judge: sample rows, result rows, sample rows without a result, results of no sample row."""
    parts = []
    ids = sample.select(on, F.lit(1).alias("in_sample"))
    for name, result in results.items():
        counted = result.groupBy(on).agg(F.count(F.lit(1)).alias("n_results"))
        parts.append(
            ids.join(counted, on, "full_outer")
            .agg(
                F.count("in_sample").alias("n_sample"),
                F.coalesce(F.sum("n_results"), F.lit(0)).alias("n_results"),
                F.count_if(F.col("n_results").isNull()).alias("n_missing"),
                F.count_if(F.col("in_sample").isNull()).alias("n_unknown"),
            )
            .select(F.lit(name).alias("judge"), "*")
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def assert_complete(sample: DataFrame, results: Mapping[str, DataFrame], on: str = "row_id") -> None:
    """Raise unless every judge has a result for every sample row, and for no other, and every sample row has an id of its own.
    Repeated records of a row are no error: ``align`` resolves them."""
    rows, ids = sample.agg(F.count(F.lit(1)), F.countDistinct(on)).first()
    if rows != ids:
        raise RuntimeError(f"{rows - ids} of {rows} sample rows have no id of their own")
    for row in completeness(sample, results, on).collect():
        if row.n_missing or row.n_unknown:
            raise RuntimeError(
                f"{row.judge} does not cover the sample: {row.n_missing} of {row.n_sample} rows lack a record, "
                f"{row.n_unknown} records belong to no row"
            )


def number_code(label: Column) -> Column:
    """A numeric label: 0, 1 or null (a refusal); any other is an error."""
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), label.cast("string"))).cast("int")
    return F.when(label.isNull() | label.isin(0, 1), label.cast("int")).otherwise(unknown)


def answer_code(label: Column) -> Column:
    """attack → 1, benign → 0, no label → null (a refusal); any other label is an error."""
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), label)).cast("int")
    return F.when(label.isNull(), F.lit(None).cast("int")).otherwise(F.coalesce(encode_label(label), unknown))


def judged(aligned: DataFrame, judges: Sequence[Judge], keep: Sequence[str] = (LABEL, SOURCE)) -> DataFrame:
    """Long form: one row per row and judge (judge, prediction, prob_positive)."""
    entries = [
        F.struct(
            F.lit(j.name).alias("judge"),
            F.col(j.prediction).cast("int").alias("prediction"),
            (F.col(j.prob) if j.prob else F.lit(None)).cast("double").alias("prob_positive"),
        )
        for j in judges
    ]
    return aligned.select(*keep, F.explode(F.array(*entries)).alias("j")).select(*keep, "j.*")


def refusals(aligned: DataFrame, judges: Sequence[Judge], source: str = SOURCE) -> DataFrame:
    """Per judge, overall and per source: rows without an answer, and all rows."""
    long = judged(aligned, judges, [source])
    counted = long.groupBy("judge", source).agg(
        F.count_if(F.col("prediction").isNull()).alias("n_refused"),
        F.count(F.lit(1)).alias("n_total"),
    )
    return (
        counted.rollup("judge", source)
        .agg(
            F.sum("n_refused").alias("n_refused"),
            F.sum("n_total").alias("n_total"),
            F.grouping("judge").alias("_g"),
            F.grouping(source).alias("_s"),
        )
        .where("_g = 0")
        .select(
            "judge",
            F.when(F.col("_s") == 1, "overall").otherwise("source").alias("scope"),
            source,
            "n_refused",
            "n_total",
        )
    )


def compare_judges(aligned: DataFrame, judges: Sequence[Judge], source: str = SOURCE) -> DataFrame:
    """All metrics per judge, overall and per source, for any number of judges.

    A refused row is left out for the judge that refused only. Ranking and calibration metrics come
    out for judges with a probability.
    """
    answered = judged(aligned, judges, [LABEL, source]).where(F.col("prediction").isNotNull())
    return binary_metrics(answered, ["judge"], source, "prob_positive").drop("log_loss")


def pairwise_agreement(aligned: DataFrame, judges: Sequence[Judge]) -> DataFrame:
    """Per pair of judges on the rows both answered: rows, raw agreement rate, Cohen's kappa.

    Kappa is null where chance agreement is complete. All pairs are counted in one pass: each row
    feeds one cell per pair, and there are four cells per pair.
    """
    pairs = [
        F.struct(
            F.lit(a.name).alias("judge_a"),
            F.lit(b.name).alias("judge_b"),
            F.col(a.prediction).cast("int").alias("a"),
            F.col(b.prediction).cast("int").alias("b"),
        )
        for a, b in combinations(judges, 2)
    ]
    counted = (
        aligned.select(F.explode(F.array(*pairs)).alias("p"))
        .select("p.*")
        .groupBy("judge_a", "judge_b")
        .agg(
            F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n"),
            F.count_if(F.col("a") == F.col("b")).alias("_same"),
            F.count_if((F.col("a") == 1) & F.col("b").isNotNull()).alias("_a1"),
            F.count_if((F.col("b") == 1) & F.col("a").isNotNull()).alias("_b1"),
        )
    )
    n = F.col("n").cast("double")
    chance = F.try_divide(
        F.col("_a1") * F.col("_b1").cast("double") + (n - F.col("_a1")) * (n - F.col("_b1")), n * n
    )
    rate = F.try_divide(F.col("_same").cast("double"), n)
    return counted.select(
        "judge_a",
        "judge_b",
        "n",
        rate.alias("raw_agreement_rate"),
        F.try_divide(rate - chance, 1 - chance).alias("cohen_kappa"),
    )


def agreement_rate(aligned: DataFrame, a: Judge, b: Judge) -> DataFrame:
    return pairwise_agreement(aligned, [a, b]).select("n", "raw_agreement_rate")


def cohen_kappa(aligned: DataFrame, a: Judge, b: Judge) -> DataFrame:
    return pairwise_agreement(aligned, [a, b]).select("n", "cohen_kappa")


def disagreements(
    aligned: DataFrame, a: Judge, b: Judge, source: str = SOURCE, n_chars: int = PREVIEW_CHARS
) -> DataFrame:
    """Rows both judges answered differently, with the start of the text."""
    first, second = F.col(a.prediction).cast("int"), F.col(b.prediction).cast("int")
    return aligned.where(first != second).select(
        "row_id",
        source,
        F.col(LABEL).alias("true_label"),
        first.alias(f"{a.name}_prediction"),
        second.alias(f"{b.name}_prediction"),
        preview(F.col("text"), n_chars).alias("text_preview"),
    )
