"""Language contamination of the false positives of one source."""

from __future__ import annotations

from pyspark.sql import DataFrame

from textguard.operators.language import (
    LanguageDetector,
    benign_language_outcome,
    detect_language,
    language_counts,
    language_rates,
)
from textguard.operators.normalize import filter_source


def language_report(
    scored: DataFrame, source: str, detector: LanguageDetector | None = None
) -> dict[str, DataFrame]:
    """Rates, counts per language and benign language x outcome counts of a scored source.

    Without a detector the table must already have a ``language`` column.
    """
    rows = filter_source(scored, source)
    if detector is not None:
        rows = detect_language(rows, detector)
    rows = rows.select("label", "prediction", "language")
    return {
        "rates": language_rates(rows),
        "language_counts": language_counts(rows),
        "benign_language_outcome": benign_language_outcome(rows),
    }
