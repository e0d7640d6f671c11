"""The judge comparison report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.operators.agreement import (
    Judge,
    align,
    answer_code,
    number_code,
    assert_complete,
    compare_judges,
    disagreements,
    pairwise_agreement,
    refusals,
)


def compare_logs(
    sample: DataFrame, results: Mapping[str, DataFrame], judges: Sequence[Judge], on: str = "row_id"
) -> dict[str, DataFrame]:
    """The report from result logs: logs must cover the sample; retried rows count once; unknown labels are an error."""
    assert_complete(sample, results, on)
    aligned = align(sample, results, on)
    for name, result in results.items():
        label = F.col(f"{name}_predicted_label")
        kind = dict(result.dtypes).get("predicted_label")
        if kind == "string":
            aligned = aligned.withColumn(f"{name}_prediction", answer_code(label))
        elif kind is not None:
            aligned = aligned.withColumn(f"{name}_predicted_label", number_code(label))
    return comparison_report(aligned, judges)


def comparison_report(aligned: DataFrame, judges: Sequence[Judge]) -> dict[str, DataFrame]:
    """Metrics and refusals per judge, agreement per pair, and the disagreements of the first two."""
    return {
        "metrics": compare_judges(aligned, judges),
        "refusals": refusals(aligned, judges),
        "pairwise_agreement": pairwise_agreement(aligned, judges),
        "disagreements": disagreements(aligned, judges[0], judges[1]),
    }
